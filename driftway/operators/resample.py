"""Bootstrap resampling of loci or genomic blocks, and its summary.

Draws are functions of hashes of (seed, replicate, draw, unit or tree node),
never of partitioning: a task that is run again repeats its draws.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import is_finite
from driftway.functions.special import project_counts
from driftway.operators.draws import multinomial_weights
from driftway.operators.ranking import bucketed_rank
from driftway.operators.spectra import CONFIGURATION, PAIR, configurations, project
from driftway.session import materialize, parts_of

# Width of the ordinal buckets along a chromosome, in blocks.
_ORDINAL_BUCKET = 4096
_DRAWS_PER_ROW = 10_000
# Draws that one task unrolls and counts.
_DRAWS_PER_TASK = 500_000
# Numbers that a task holds at once when it adds up projected cells.
_CELLS_AT_ONCE = 2_000_000
# Replicates carried side by side in one row.
_LANES = 16


def resampling_unit_label(block_size_bp: int | None) -> str:
    return "locus" if block_size_bp is None else f"{block_size_bp}-bp genomic block"


def block_configurations(shared: DataFrame, block_size_bp: int) -> DataFrame:
    """Configurations counted per pair and fixed window; positions are 1-based."""
    if block_size_bp < 1:
        raise ValueError("a block has at least one base pair.")
    block = F.floor((F.col("pos") - 1) / F.lit(block_size_bp))
    return configurations(shared.withColumn("block", block), by=["chrom", "block"])


def block_spectra(shared: DataFrame, block_size_bp: int, chromosomes_a: int, chromosomes_b: int) -> DataFrame:
    """Projected mass per pair, window and cell; windows without a usable locus are absent.

    A window's few configurations meet in one row, and its cells are added up there: no row per configuration and cell.
    """
    if chromosomes_a < 1 or chromosomes_b < 1:
        raise ValueError("a projection size is below 1.")
    usable = block_configurations(shared, block_size_bp).filter((F.col("n_a") >= chromosomes_a) & (F.col("n_b") >= chromosomes_b))
    keys = [*PAIR, "chrom", "block"]
    held = usable.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("long") for c in CONFIGURATION], "loci")).alias("held"))
    cells = (chromosomes_a + 1) * (chromosomes_b + 1)
    step = max(1, _CELLS_AT_ONCE // cells)

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                mass = _window_cells(part.column(len(keys)), chromosomes_a, chromosomes_b, step)
                row, cell = np.nonzero(mass)
                found = [part.column(k).take(pa.array(row)) for k in range(len(keys))]
                i, j = np.divmod(cell, chromosomes_b + 1)
                yield pa.RecordBatch.from_arrays([*found, pa.array(i), pa.array(j), pa.array(mass[row, cell])], names=[*keys, "i", "j", "mass"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name in keys]
    return held.mapInArrow(rows, ", ".join([*kinds, "i long", "j long", "mass double"]))


def _window_cells(held: pa.ListArray, chromosomes_a: int, chromosomes_b: int, step: int) -> np.ndarray:
    """Projected mass, a row per list of configurations and a column per cell."""
    ends = held.value_lengths().to_numpy().cumsum()
    n_a, x_a, n_b, x_b, loci = (part.to_numpy() for part in held.flatten().flatten())
    mass = np.zeros((len(held), (chromosomes_a + 1) * (chromosomes_b + 1)))
    for at in range(0, len(loci), step):
        to = slice(at, at + step)
        a = project_counts(n_a[to], x_a[to], chromosomes_a) * loci[to, None]
        both = a[:, :, None] * project_counts(n_b[to], x_b[to], chromosomes_b)[:, None, :]
        window = np.searchsorted(ends, np.arange(at, at + len(both)), side="right")
        first = np.flatnonzero(np.diff(window, prepend=-1))
        mass[window[first]] += np.add.reduceat(both.reshape(len(both), -1), first)
    return mass


def block_ordinals(blocks: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """0-based number of each block within its key, in (chrom, block) order."""
    distinct = blocks.select(*keys, "chrom", "block").distinct()
    stretch = F.floor(F.col("block") / _ORDINAL_BUCKET)
    ranked = bucketed_rank(distinct, keys, [F.col("chrom"), stretch], [F.col("block")], "_rank")
    return ranked.select(*keys, "chrom", "block", (F.col("_rank") - 1).alias("ordinal"))


def draw_counts(sizes: DataFrame, replicates: int, seed: int, keys: list[str] = PAIR) -> DataFrame:
    """How often each ordinal is drawn: ``n`` draws with replacement per key and replicate.

    ``sizes`` holds keys and ``n``, and may hold ``seed_offset``. Draw d of
    replicate r is the first 12 hex digits of md5("seed:r:d") modulo n. Draws are
    made in rows of 10,000 so that no single row or task unrolls a whole genome.
    """
    if replicates < 2:
        raise ValueError("two replicates at least are needed.")
    offset = F.col("seed_offset") if "seed_offset" in sizes.columns else F.lit(0)
    # a row per key; a few bytes of chunks become many draws, so tasks are dealt by draws and not by the size of the chunks
    sizes = materialize(sizes)
    draws = (sizes.agg(F.sum("n")).first()[0] or 0) * replicates
    rows = sizes.select(
        *keys, "n", (F.lit(seed) + offset).alias("seed"),
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"),
    )
    chunks = rows.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _DRAWS_PER_ROW))).alias("chunk")
    ).repartition(parts_of(draws, _DRAWS_PER_TASK), *keys, "replicate", "chunk")
    start = F.col("chunk") * _DRAWS_PER_ROW
    stop = F.least(F.col("n"), start + _DRAWS_PER_ROW) - 1
    draws = chunks.select(*keys, "n", "seed", "replicate", F.explode(F.sequence(start, stop)).alias("draw"))
    digest = F.md5(F.concat_ws(":", "seed", "replicate", "draw"))
    ordinal = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("n")
    return draws.groupBy(*keys, "replicate", ordinal.alias("ordinal")).agg(F.count("*").alias("weight"))


def resample_blocks(
    cells: DataFrame, replicates: int, seed: int, keys: list[str] = PAIR, offsets: DataFrame | None = None
) -> DataFrame:
    """Replicate spectra from block spectra: (keys, replicate, i, j, mass).

    ``offsets`` (keys, seed_offset) gives each pair its own stream.
    """
    weighted, lanes = _drawn_blocks(cells, replicates, seed, keys, offsets)
    summed = weighted.groupBy(*keys, "_group", "i", "j").agg(*[F.sum(F.col(w) * F.col("mass")).alias(w) for w in lanes])
    return _spread(summed, lanes, [*keys, "i", "j"], "mass").select(*keys, "replicate", "i", "j", "mass")


def resample_block_configurations(
    blocks: DataFrame, replicates: int, seed: int, chromosomes_a: int, chromosomes_b: int,
    keys: list[str] = PAIR, offsets: DataFrame | None = None,
) -> DataFrame:
    """Replicate spectra from counted configurations per block: (keys, replicate, i, j, mass).

    Draws the same blocks as ``resample_blocks``, but sums drawn loci per configuration first and projects each
    replicate once: a block holds far fewer configurations than projected cells. ``blocks`` is read twice.
    """
    usable = blocks.filter((F.col("n_a") >= chromosomes_a) & (F.col("n_b") >= chromosomes_b))
    weighted, lanes = _drawn_blocks(usable, replicates, seed, keys, offsets)
    summed = weighted.groupBy(*keys, "_group", *CONFIGURATION).agg(
        *[F.sum(F.col(w) * F.col("loci")).alias(w) for w in lanes]
    )
    drawn = _spread(summed, lanes, [*keys, *CONFIGURATION], "weight")
    return project(drawn, chromosomes_a, chromosomes_b, [*keys, "replicate"], weight="weight")


def poisson_ends() -> list[int]:
    """Poisson(1) weights 0, 1, ... end at these values of a 48-bit draw: the whole part of 2**48 * P(weight <= k)."""
    inverse = sum(Fraction((-1) ** k, factorial(k)) for k in range(40))  # 1 / e
    return [int((1 << 48) * inverse * sum(Fraction(1, factorial(k)) for k in range(top + 1))) for top in range(17)]


def unit_draw(seed: int | Column, replicate: Column, *names: str) -> Column:
    """A 48-bit draw of the unit that ``names`` tell: the first 12 hex digits of md5("seed|replicate|name|...")."""
    digest = F.md5(F.concat_ws("|", F.lit(seed) if isinstance(seed, int) else seed, replicate, *names))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def poisson_weight(draw: Column) -> Column:
    """The Poisson(1) weight of a draw, by inverting the distribution: no other unit is asked and none has a number."""
    weight = F.lit(len(poisson_ends()))
    for k, end in reversed(list(enumerate(poisson_ends()))):
        weight = F.when(draw < end, k).otherwise(weight)
    return weight


def poisson_block_configurations(
    blocks: DataFrame, replicates: int, seed: int, chromosomes_a: int, chromosomes_b: int,
    keys: list[str] = PAIR, offsets: DataFrame | None = None,
) -> DataFrame:
    """Replicate spectra of a Poisson block bootstrap: (keys, replicate, i, j, mass).

    Each block has a Poisson(1) weight of its own in each replicate, a function of (seed, keys, replicate, chrom, block).
    So a replicate has as many blocks as were given on average, with the variance of that number, and a block's weights
    have the distribution that drawing with replacement tends to with many blocks. Nothing is numbered, sampled or joined:
    the weights are computed where the block's configurations meet, and these are added up at once. A replicate in which
    no block has weight has no rows.
    """
    if replicates < 2:
        raise ValueError("two replicates at least are needed.")
    usable = blocks.filter((F.col("n_a") >= chromosomes_a) & (F.col("n_b") >= chromosomes_b))
    if offsets is not None:
        usable = usable.join(offsets, keys)
    offset = [F.first("seed_offset").alias("seed_offset")] if offsets is not None else []
    # the configurations of a window are few, and each is in it once
    held = usable.groupBy(*keys, "chrom", "block").agg(F.collect_list(F.struct(*CONFIGURATION, "loci")).alias("held"), *offset)
    of = F.lit(seed) + F.col("seed_offset") if offsets is not None else seed
    lanes = [f"_w{k}" for k in range(min(_LANES, replicates))]
    groups = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // _LANES))).alias("_group")
    names = [*keys, "chrom", "block"]
    drawn = held.select("*", groups).select(
        *keys, "_group", "held", *[unit_draw(of, F.col("_group") * _LANES + k, *names).alias(w) for k, w in enumerate(lanes)]
    )
    weights = [
        F.when(F.col("_group") * _LANES + k < replicates, poisson_weight(F.col(w))).otherwise(0).alias(w) for k, w in enumerate(lanes)
    ]
    weighted = drawn.select(*keys, "_group", "held", *weights)
    rows = weighted.select(*keys, "_group", *lanes, F.explode("held").alias("c")).select(*keys, "_group", *lanes, "c.*")
    summed = rows.groupBy(*keys, "_group", *CONFIGURATION).agg(*[F.sum(F.col(w) * F.col("loci")).alias(w) for w in lanes])
    drawn = _spread(summed, lanes, [*keys, *CONFIGURATION], "weight")
    return project(drawn, chromosomes_a, chromosomes_b, [*keys, "replicate"], weight="weight")


def _drawn_blocks(rows: DataFrame, replicates: int, seed: int, keys: list[str], offsets: DataFrame | None):
    """Rows of blocks with one column of draws per lane, and the names of these columns."""
    ordinals = materialize(block_ordinals(rows, keys))
    sizes = ordinals.groupBy(*keys).agg(F.count("*").alias("n"))
    few = F.raise_error(F.lit("one block can't be resampled: take smaller blocks."))
    sizes = sizes.withColumn("n", F.when(F.col("n") >= 2, F.col("n")).otherwise(few.cast("long")))
    if offsets is not None:
        sizes = sizes.join(offsets, keys)
    weights = draw_counts(sizes, replicates, seed, keys).withColumn("_lane", F.col("replicate") % _LANES)
    # Replicates travel side by side, so that a row joins once per 16 of them.
    lanes = [f"_w{k}" for k in range(min(_LANES, replicates))]
    drawn = weights.groupBy(*keys, "ordinal", F.floor(F.col("replicate") / _LANES).alias("_group")).agg(
        *[F.sum(F.when(F.col("_lane") == k, F.col("weight")).otherwise(0)).alias(w) for k, w in enumerate(lanes)]
    )
    # all three have rows per block; the planner takes the draws for as few as the sizes they unroll from, and would broadcast them
    placed = drawn.join(ordinals.hint("merge"), [*keys, "ordinal"])
    return placed.join(rows.hint("merge"), [*keys, "chrom", "block"]), lanes


def _spread(summed: DataFrame, lanes: list[str], keep: list[str], value: str) -> DataFrame:
    """One row per replicate with a positive sum from rows that hold the replicates of a group side by side."""
    spread = summed.select(*keep, "_group", F.posexplode(F.array(*lanes)).alias("_lane", value))
    return spread.filter(F.col(value) > 0).select(
        *keep, (F.col("_group") * _LANES + F.col("_lane")).cast("int").alias("replicate"), value
    )


def resample_loci(
    configs: DataFrame, replicates: int, seed: int, chromosomes_a: int, chromosomes_b: int
) -> DataFrame:
    """Replicate spectra of a locus bootstrap: (pair, replicate, i, j, mass).

    Only loci usable at the projection size take part.
    """
    usable = configs.filter((F.col("n_a") >= chromosomes_a) & (F.col("n_b") >= chromosomes_b))
    loci = usable.groupBy(*PAIR).agg(F.sum("loci").alias("n"))
    few = F.raise_error(F.lit("one usable locus can't be resampled.")).cast("boolean")
    enough = loci.filter(F.when(F.col("n") >= 2, F.lit(True)).otherwise(few)).select(*PAIR)
    weights = multinomial_weights(
        usable.join(enough, PAIR, "left_semi"), PAIR, CONFIGURATION, "loci", replicates, seed, slots=[F.col("n_a"), F.col("x_a")]
    )
    return project(weights, chromosomes_a, chromosomes_b, [*PAIR, "replicate"], weight="weight")


# An estimator maps replicate spectra (keys, i, j, mass) to (keys, m_a_to_b, m_b_to_a).
Estimator = Callable[[DataFrame, list[str]], DataFrame]


def linear_moment_estimator(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rates linear in the mean alternate counts of the two sides."""
    total = F.sum("mass")
    mean_i = F.sum(F.col("i") * F.col("mass")) / total
    mean_j = F.sum(F.col("j") * F.col("mass")) / total
    return cells.groupBy(*keys).agg(
        (0.02 + 0.002 * mean_j).alias("m_a_to_b"), (0.005 + 0.0005 * mean_i).alias("m_b_to_a")
    )


def grouped_estimator(fit: Callable) -> Estimator:
    """Wrap ``fit(cells: pandas.DataFrame) -> (m_a_to_b, m_b_to_a)`` as an estimator.

    One call gets one replicate spectrum, at most (n_a + 1)(n_b + 1) rows. Where the fit raises, the replicate keeps its
    row without rates, and ``failure`` says why; a summary counts it as attempted and not as successful.
    """

    def estimate(cells: DataFrame, keys: list[str]) -> DataFrame:
        key_types = [f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys]

        def run(frame):
            try:
                forward, reverse = fit(frame[["i", "j", "mass"]])
                found = float(forward), float(reverse), None
            except Exception as error:  # the fit is the caller's: whatever it raises is told, not hidden
                found = float("nan"), float("nan"), f"{type(error).__name__}: {error}"
            out = frame[keys].iloc[:1].copy()  # keeps the types of the keys
            return out.assign(m_a_to_b=found[0], m_b_to_a=found[1], failure=found[2])

        schema = ", ".join([*key_types, "m_a_to_b double", "m_b_to_a double", "failure string"])
        return cells.groupBy(*keys).applyInPandas(run, schema)

    return estimate


def bootstrap_summary(
    estimates: DataFrame,
    keys: list[str] = PAIR,
    *,
    confidence: float = 0.95,
    attempted: int | None = None,
    on_too_few: str = "raise",
) -> DataFrame:
    """Means, percentile intervals and direction support over finite replicate estimates.

    Groups hold one row per replicate, so exact percentiles stay small.
    ``on_too_few='drop'`` leaves keys with fewer than two finite estimates out
    instead of failing.
    """
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence is a number above 0 and below 1.")
    ab, ba = F.col("m_a_to_b"), F.col("m_b_to_a")
    low = (1.0 - confidence) / 2.0
    finite = is_finite(ab) & is_finite(ba)
    x, y = F.when(finite, ab), F.when(finite, ba)
    grouped = estimates.groupBy(*keys).agg(
        F.avg(x).alias("m_a_to_b_mean"),
        F.percentile(x, low).alias("m_a_to_b_lower"),
        F.percentile(x, 1.0 - low).alias("m_a_to_b_upper"),
        F.avg(y).alias("m_b_to_a_mean"),
        F.percentile(y, low).alias("m_b_to_a_lower"),
        F.percentile(y, 1.0 - low).alias("m_b_to_a_upper"),
        F.avg(F.when(finite, (ab > ba).cast("double"))).alias("probability_a_to_b_stronger"),
        F.count_if(finite).alias("successful_replicates"),
        (F.count("*") if attempted is None else F.lit(attempted).cast("long")).alias("attempted_replicates"),
    )
    enough = F.col("successful_replicates") >= 2
    if on_too_few == "raise":
        few = F.raise_error(F.lit("only one replicate, or none, has finite estimates."))
        grouped = grouped.filter(F.when(enough, F.lit(True)).otherwise(few.cast("boolean")))
    else:
        grouped = grouped.filter(enough)
    p = F.col("probability_a_to_b_stronger")
    preferred = F.when(F.col("m_a_to_b_mean") >= F.col("m_b_to_a_mean"), p).otherwise(1.0 - p)
    return grouped.withColumn("preferred_direction_support", preferred)
