"""Scalar functions on migration rates, directions and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0088


def asymmetry_index(forward: Column, reverse: Column) -> Column:
    """Normalised difference in [-1, 1]; 0 when both rates are 0."""
    total = forward + reverse
    return F.when(total == 0, F.lit(0.0)).otherwise((forward - reverse) / total)


def directional_ratio(forward: Column, reverse: Column) -> Column:
    """forward / reverse, with infinity (or 1) when the reverse rate is 0."""
    at_zero = F.when(forward > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return F.when(reverse == 0, at_zero).otherwise(forward / reverse)


def arrow(source: Column, destination: Column) -> Column:
    return F.concat(source, F.lit("->"), destination)


def preferred_arrow(source: Column, destination: Column, forward: Column, reverse: Column) -> Column:
    """``x->y`` along the larger rate, NULL on a tie."""
    return F.when(forward > reverse, arrow(source, destination)).when(
        reverse > forward, arrow(destination, source)
    )


def preferred_label(forward: Column, reverse: Column) -> Column:
    """Benchmark spelling of the preferred direction between A and B."""
    return (
        F.when(forward > reverse, F.lit("A->B"))
        .when(reverse > forward, F.lit("B->A"))
        .otherwise(F.lit("symmetric"))
    )


def directional_support(p_forward: Column, forward: Column, reverse: Column) -> Column:
    """Turn P(forward stronger) into support for the direction the point rates prefer."""
    return (
        F.when(forward > reverse, p_forward).when(reverse > forward, 1.0 - p_forward).otherwise(F.lit(0.5))
    )


def intervals_separate(fl: Column, fu: Column, rl: Column, ru: Column) -> Column:
    """True iff the two intervals do not touch; a missing bound means not separated."""
    return F.coalesce((fl > ru) | (rl > fu), F.lit(False)) & (
        fl.isNotNull() & fu.isNotNull() & rl.isNotNull() & ru.isNotNull()
    )


def nearly_equal(x: Column, y: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(x - y) <= absolute + relative * F.abs(y)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Cartesian position on the unit sphere, used to grid coordinates without pole effects."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)
