"""Migration rates from allele frequencies before and after one generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import enforce, in_unit_interval, is_finite, require_columns
from driftway.operators.draws import multinomial_weights
from driftway.operators.resample import bootstrap_summary
from driftway.session import materialize

FREQUENCIES = ("p_a_initial", "p_b_initial", "p_a_final", "p_b_final")
DIRECTIONS = ("a_to_b", "b_to_a")

_FLOOR = 1e-12
_END = 1e-9
_SLOTS = 4096
# Points inside a bracket in each pass of a search, and passes: (48 + 1) ** 3 is about 1e5.
_POINTS, _PASSES = 48, 3


def checked_frequencies(loci: DataFrame) -> DataFrame:
    require_columns(loci, FREQUENCIES, "frequency table")
    return enforce(
        loci,
        [(in_unit_interval(F.col(name)), f"{name} has a value that is no allele frequency.") for name in FREQUENCIES],
    )


def directed_observations(loci: DataFrame, ne_a: int, ne_b: int, keep: list[str] | None = None) -> DataFrame:
    """Two rows per locus, one per direction: source and recipient start, allele count after, 2 Ne.

    Migration from A to B shows in population B, and the other way round.
    """
    if ne_a <= 0 or ne_b <= 0:
        raise ValueError("an effective population size has to be above zero.")

    def side(name: str, source: str, recipient: str, final: str, ne: int) -> Column:
        size = F.lit(2.0 * ne)
        # rint rounds halves to even.
        count = F.least(F.greatest(F.rint(F.col(final) * size), F.lit(0.0)), size)
        return F.struct(
            F.lit(name).alias("direction"), F.col(source).alias("source"), F.col(recipient).alias("recipient"),
            count.alias("count"), size.alias("size"),
        )

    both = F.array(
        side("a_to_b", "p_a_initial", "p_b_initial", "p_b_final", ne_b),
        side("b_to_a", "p_b_initial", "p_a_initial", "p_a_final", ne_a),
    )
    return loci.select(*(keep or []), F.explode(both).alias("o")).select(*(keep or []), "o.*")


def _expected(m: Column) -> Column:
    mixed = (1.0 - m) * F.col("recipient") + m * F.col("source")
    return F.least(F.greatest(mixed, F.lit(_FLOOR)), F.lit(1.0 - _FLOOR))


def _log_likelihood(m: Column) -> Column:
    """Binomial log-likelihood of one observation up to a constant; 0 ln 0 counts as 0."""
    e = _expected(m)
    rest = F.col("size") - F.col("count")
    return F.when(F.col("count") > 0, F.col("count") * F.log(e)).otherwise(0.0) + F.when(
        rest > 0, rest * F.log1p(-e)
    ).otherwise(0.0)


def transition_scan(loci: DataFrame, ne_a: int, ne_b: int, rates: list[float]) -> DataFrame:
    """Log-likelihood of every rate in a grid for both directions, in one pass over the loci."""
    observed = directed_observations(loci, ne_a, ne_b)
    sums = [F.sum(_log_likelihood(F.lit(float(m)))).alias(f"_{k}") for k, m in enumerate(rates)]
    totals = observed.groupBy("direction").agg(*sums)
    cells = F.array(*[
        F.struct(F.lit(float(m)).alias("m"), F.col(f"_{k}").alias("log_likelihood")) for k, m in enumerate(rates)
    ])
    return totals.select("direction", F.explode(cells).alias("c")).select("direction", "c.*")


def _slope(m: Column, weight: Column) -> Column:
    """Summed slope of the log-likelihood at ``m``; a locus at the floor of its expectation has none."""
    e = _expected(m)
    step = F.when((e > _FLOOR) & (e < 1.0 - _FLOOR), F.col("source") - F.col("recipient")).otherwise(0.0)
    return F.sum(weight * step * (F.col("count") / e - (F.col("size") - F.col("count")) / (1.0 - e)))


def _narrowed(points: Column) -> list[Column]:
    """low, high and the slopes there, from sorted points (k, m, slope): the last that rises and the one after it."""
    rising = F.size(F.filter(F.slice(points, 2, _POINTS), lambda x: x["slope"] > 0))
    low, high = F.element_at(points, rising + 1), F.element_at(points, rising + 2)
    return [low["m"].alias("low"), high["m"].alias("high"), low["slope"].alias("rise"), high["slope"].alias("fall")]


def maximise(observed: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, direction, m in [0, 1] that maximises the summed likelihood, and the log-likelihood there.

    The log-likelihood is concave in m, so its slope tells on which side of a point the maximum lies. A pass is one
    aggregate: it takes the slope at ``_POINTS`` points inside every bracket of all keys and directions and keeps the
    interval where the sign changes, which is 49 times narrower. ``_PASSES`` passes narrow [0, 1] to 1e-5; inside the last
    interval the slope is taken as straight, which leaves about the square of that. Brackets are a small table, a row per key and direction, that the next pass
    broadcasts; the driver sees none of them. ``observed`` is read once a pass, so give a written table.
    """
    w = F.lit(1.0) if weight is None else weight
    at = [*keys, "direction"]
    listed = F.sort_array(F.collect_list(F.struct("k", "m", "slope"))).alias("p")  # a row per point of a bracket
    # the first pass looks just inside the ends, where a locus fixed at the start still has a slope
    places = [_END, *[k / (_POINTS + 1) for k in range(1, _POINTS + 1)], 1.0 - _END]
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(places)])).alias("x")
    slopes = observed.select("*", points).select("*", "x.*").groupBy(*at, "k", "m").agg(_slope(F.col("m"), w).alias("slope"))
    found = slopes.groupBy(*at).agg(listed).select(*at, *_narrowed(F.col("p")))
    # at an end of [0, 1] the maximum is the end itself
    first, last = F.col("low") == _END, F.col("high") == 1.0 - _END
    end = F.when(first & (F.col("rise") <= 0), F.lit(0.0)).when(last & (F.col("fall") >= 0), F.lit(1.0))
    brackets = found.select(*at, F.coalesce(end, "low").alias("low"), F.coalesce(end, "high").alias("high"), "rise", "fall")
    bracket = [*at, "low", "high", "rise", "fall"]
    for _ in range(_PASSES - 1):
        met = observed.join(F.broadcast(brackets), at)  # as many rows as keys times two
        asked = met.select("*", F.explode(F.sequence(F.lit(1), F.lit(_POINTS))).alias("k")).withColumn(
            "m", F.col("low") + F.col("k") * ((F.col("high") - F.col("low")) / (_POINTS + 1))
        )
        slopes = asked.groupBy(*bracket, "k", "m").agg(_slope(F.col("m"), w).alias("slope"))
        sides = [F.array(F.struct(F.lit(k).alias("k"), F.col(m).alias("m"), F.col(x).alias("slope"))) for k, m, x in ((0, "low", "rise"), (_POINTS + 1, "high", "fall"))]
        brackets = slopes.groupBy(*bracket).agg(listed).select(*at, *_narrowed(F.concat(sides[0], "p", sides[1])))
    width = F.col("high") - F.col("low")
    straight = F.when((F.col("rise") > 0) & (F.col("fall") < 0), F.col("rise") / (F.col("rise") - F.col("fall"))).otherwise(0.5)
    found = brackets.select(*at, (F.col("low") + width * straight).alias("m"))
    met = observed.join(F.broadcast(found), at)
    return met.groupBy(*at).agg(F.first("m").alias("m"), F.sum(w * _log_likelihood(F.col("m"))).alias("log_likelihood"))


def _both_directions(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m_a_to_b, m_b_to_a and the joint log-likelihood."""
    rate = {d: F.max(F.when(F.col("direction") == d, F.col("m"))).alias(f"m_{d}") for d in DIRECTIONS}
    return found.groupBy(*keys).agg(*rate.values(), F.sum("log_likelihood").alias("log_likelihood"))


def estimate_one_generation(loci: DataFrame, ne_a: int, ne_b: int) -> DataFrame:
    """One row: m_a_to_b, m_b_to_a, their joint log-likelihood, and success: both rates have a finite one."""
    if not loci.limit(1).count():
        raise ValueError("there are no loci to estimate from.")
    observed = materialize(directed_observations(checked_frequencies(loci), ne_a, ne_b))
    found = _both_directions(maximise(observed, []), [])
    return found.withColumn("success", F.coalesce(is_finite(F.col("log_likelihood")), F.lit(False)))


def bootstrap_estimates(
    loci: DataFrame, ne_a: int, ne_b: int, *, replicates: int, seed: int, locus: str = "locus"
) -> DataFrame:
    """Rates of every bootstrap replicate, all replicates fitted together in each pass.

    Loci with equal frequencies carry the same information, so they are counted
    first and drawn as one unit.
    """
    kinds = checked_frequencies(loci).groupBy(*FREQUENCIES).agg(F.count("*").alias("loci"))
    # numbered inside slots of the first frequency, so that no window holds all kinds
    slots = [F.floor(F.col(FREQUENCIES[0]) * _SLOTS)]
    weights = multinomial_weights(kinds, [], list(FREQUENCIES), "loci", replicates, seed, slots=slots)
    observed = materialize(directed_observations(weights, ne_a, ne_b, keep=["replicate", "weight"]))
    found = _both_directions(maximise(observed, ["replicate"], F.col("weight")), ["replicate"])
    return found.select("replicate", "m_a_to_b", "m_b_to_a")


def bootstrap_one_generation(
    loci: DataFrame, ne_a: int, ne_b: int, *, replicates: int = 200, confidence: float = 0.95, seed: int = 0
) -> DataFrame:
    """Bootstrap means, intervals and P(A->B stronger) of the one-generation estimator."""
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence is a number above 0 and below 1.")
    estimates = bootstrap_estimates(loci, ne_a, ne_b, replicates=replicates, seed=seed)
    summary = bootstrap_summary(estimates, [], confidence=confidence, attempted=replicates)
    return summary.withColumn("replicates", F.lit(replicates))
