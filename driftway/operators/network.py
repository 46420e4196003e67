"""Directed flow networks and their map layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import (
    as_number,
    enforce,
    first_values,
    in_unit_interval,
    is_rate,
    require_columns,
    require_unit_interval,
)
from driftway.operators.decisions import STATUSES
from driftway.session import broadcast_if_small

FLOW = ("source", "destination", "migration")


def validate_flows(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Known flow columns with every edge rule applied as the rows pass."""
    require_columns(flows, FLOW, "flow table")
    numeric = [c for c in ("support", "lower", "upper") if c in flows.columns]
    has_status = "status" in flows.columns
    frame = flows.select(
        *(keep or []), "source", "destination", as_number(flows, "migration").alias("migration"),
        *[as_number(flows, c).alias(c) for c in numeric], *(["status"] if has_status else []),
    )
    rules = [
        (F.col("source") != F.col("destination"), "self-migration edges are not supported in map input."),
        (is_rate(F.col("migration")), "a flow has a rate that is not a finite number from 0 up."),
    ]
    if "support" in numeric:
        known = F.col("support").isNull() | in_unit_interval(F.col("support"))
        rules.append((known, "support is outside 0 to 1."))
    for name in ("lower", "upper"):
        if name in numeric:
            rules.append((is_rate(F.col(name)), f"{name} has a value that is not a finite number from 0 up."))
    if {"lower", "upper"} <= set(numeric):
        rules.append((F.col("lower") <= F.col("upper"), "a flow's interval ends below its start."))
    if has_status:
        known = F.col("status").isNull() | F.col("status").isin(*STATUSES)
        rules.append((known, "a flow has a status other than supported, ambiguous and unsupported."))
    return enforce(frame, rules)


def network_edges(flows: DataFrame, *, include_ambiguous: bool = False, order: str | None = None) -> DataFrame:
    """One edge per (source, destination), all of its values from one row: the last in ``order``, else the strongest."""
    require_columns(flows, FLOW, "flow table")
    status = F.col("status") if "status" in flows.columns else F.lit("supported")
    hidden = ["unsupported"] if include_ambiguous else ["unsupported", "ambiguous"]
    shown = flows.withColumn("status", F.coalesce(status, F.lit("supported"))).filter(~F.col("status").isin(hidden))
    extras = [c for c in ("support", "asymmetry_index", "model_weight") if c in flows.columns]
    kept = ("migration", "status", *extras)
    # One row wins as a whole; equal orders are settled by its own values.
    last = F.max_by(F.struct(*kept), F.struct(F.col(order or "migration").alias("_by"), *kept))
    return shown.groupBy("source", "destination").agg(last.alias("_last")).select("source", "destination", "_last.*")


def source_sink_summary(edges: DataFrame) -> DataFrame:
    """Outgoing, incoming and net migration, role and degrees of each population with an edge."""
    sides = F.array(
        F.struct(
            F.col("source").alias("population"), F.col("migration").alias("out"), F.lit(0.0).alias("into"),
            F.lit(1).alias("o"), F.lit(0).alias("i"),
        ),
        F.struct(
            F.col("destination").alias("population"), F.lit(0.0).alias("out"), F.col("migration").alias("into"),
            F.lit(0).alias("o"), F.lit(1).alias("i"),
        ),
    )
    ends = edges.select(F.explode(sides).alias("e")).select("e.*")
    summed = ends.groupBy("population").agg(
        F.sum("out").alias("outgoing_migration"),
        F.sum("into").alias("incoming_migration"),
        F.sum("o").alias("out_degree"),
        F.sum("i").alias("in_degree"),
    )
    net = F.col("outgoing_migration") - F.col("incoming_migration")
    role = F.when(net > 0, F.lit("source-like")).when(net < 0, F.lit("sink-like")).otherwise(F.lit("balanced"))
    return summed.select(
        "population", "outgoing_migration", "incoming_migration", net.alias("net_flow"),
        role.alias("network_role"), "out_degree", "in_degree",
    )


def map_edges(
    coordinates: DataFrame,
    flows: DataFrame,
    *,
    min_migration: float = 0.0,
    min_support: float | None = None,
    include_ambiguous: bool = False,
    min_width: float = 0.7,
    max_width: float = 5.0,
    check_populations: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """Edges to draw with both end points and their line attributes.

    Width grows with the square root of the share of the largest rate, opacity
    with support; ambiguous edges are dashed.
    """
    if min_migration < 0:
        raise ValueError("min_migration must be zero or more.")
    edges = validate_flows(flows, keep).filter(F.col("migration") >= min_migration)
    if "status" in edges.columns:
        drawn = F.coalesce(F.col("status") != "unsupported", F.lit(True))
        edges = edges.filter(drawn if include_ambiguous else F.col("status") == "supported")
    if min_support is not None:
        require_unit_interval(min_support=min_support)
        if "support" not in edges.columns:
            raise ValueError("without a support column, min_support cannot apply.")
        edges = edges.filter(F.col("support") >= min_support)
    if check_populations:
        used = edges.select(F.explode(F.array("source", "destination")).alias("population")).distinct()
        unknown = first_values(used.join(coordinates, "population", "left_anti"), "population", limit=1000)
        if unknown:
            raise ValueError("populations of flows without coordinates: " + ", ".join(r[0] for r in unknown))
    # One number for the whole layer, from a pass that reads the rate column only.
    top = edges.agg(F.max("migration")).first()[0] or 0.0

    places = broadcast_if_small(coordinates.select("population", "latitude", "longitude"))
    placed = edges
    for side in ("source", "destination"):
        end = places.select(
            F.col("population").alias(side),
            F.col("latitude").alias(f"{side}_latitude"),
            F.col("longitude").alias(f"{side}_longitude"),
        )
        placed = placed.join(end, side)
    share = F.sqrt(F.greatest("migration", F.lit(0.0)) / F.lit(top)) if top > 0 else F.lit(0.0)
    support = F.coalesce("support", F.lit(1.0)) if "support" in edges.columns else F.lit(1.0)
    ambiguous = F.col("status") == "ambiguous" if "status" in edges.columns else F.lit(False)
    return placed.select(
        *(keep or []), "source", "destination", "migration",
        "source_latitude", "source_longitude", "destination_latitude", "destination_longitude",
        (min_width + (max_width - min_width) * share).alias("line_width"),
        (0.2 + 0.8 * support).alias("alpha"),
        F.when(ambiguous, F.lit("--")).otherwise(F.lit("-")).alias("line_style"),
    )
