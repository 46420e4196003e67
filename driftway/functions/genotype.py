"""Genotype fields of variant-call text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alternate and called alleles of one genotype travel in one long: alt * 2^32 + called.
ALT_SHIFT = 32
_CALLED_MASK = (1 << ALT_SHIFT) - 1


def genotype_text(field: Column, gt_position: Column) -> Column:
    """The GT part of a sample field; empty when the field is too short to hold it."""
    return F.when(gt_position == 1, F.substring_index(field, ":", 1)).otherwise(
        F.split_part(field, F.lit(":"), gt_position)
    )


def packed_alleles(gt: Column) -> Column:
    """Packed (alt, called) of a genotype, NULL when it is missing or has a non-0/1 allele.

    Diploid genotypes are matched as whole strings; other ploidies take the
    general branch. One missing or unknown allele voids the whole genotype.
    """
    slashed = F.translate(gt, "|", "/")
    alt = F.length(F.translate(slashed, "0/", "")).cast("long")
    called = F.ceil((F.length(slashed) + 1) / 2).cast("long")
    return (
        F.when(gt.isin("0/0", "0|0"), F.lit(2))
        .when(gt.isin("0/1", "0|1", "1/0", "1|0"), F.lit((1 << ALT_SHIFT) + 2))
        .when(gt.isin("1/1", "1|1"), F.lit((2 << ALT_SHIFT) + 2))
        .when(slashed.isin("./.", "."), F.lit(None))
        .when(slashed.rlike("^[01](/[01])*$"), F.shiftleft(alt, ALT_SHIFT) + called)
        .cast("long")
    )


def unpack_alt(packed: Column) -> Column:
    return F.shiftright(packed, ALT_SHIFT)


def unpack_called(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_CALLED_MASK))
