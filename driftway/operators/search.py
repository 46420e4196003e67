"""Pruned library search: the best entry per spectrum without scoring every entry.

With data d, expectation m and q = m / sum m, a log-likelihood is a constant of the spectrum plus sum d ln q. Entries with
like shapes form a cluster, and the largest q of a cluster in each cell is its envelope: sum d ln (envelope) is at least the
score of each of its entries. So the first entry of the cluster with the highest bound is scored exactly, and then only the
entries of clusters whose bound reaches that score. No entry that could win is left out: the result is that of a full scan.

Clusters come from the shares of a few blocks of cells, cut to steps of their logarithms. The step is the finest one of
``STEPS`` that leaves at most one cluster for every ``ENTRIES_PER_CLUSTER`` entries: finer clusters bound more closely, but
each is met with every spectrum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftway.functions.special import log_gamma1p
from driftway.operators.ranking import bucketed_rank
from driftway.operators.spectra import PAIR, fold_spectra
from driftway.session import broadcast_if_small, fits_in_broadcast, materialize

ENTRY = ["model", "param_id"]
# Blocks per side of the coarse spectrum, and steps of the logarithm of a block's share.
GRID = 4
STEPS = (1.6, 0.8, 0.4, 0.2, 0.1, 0.05, 0.025, 0.0125, 0.00625)
ENTRIES_PER_CLUSTER = 12
# Log-likelihoods that differ by less count as equal; the smaller id wins.
TIE = 1e-6
_LANES = 8
_SLOT_BUCKETS = 256
# Stands for an empty block.
_LEAST = 1e-300
# Rows of spectra, or of spectra by parts, that are broadcast. What has a row per entry or cluster grows with the library:
# it is joined by merging, so that neither a count nor an estimated size sends it through the driver.
_SPECTRA_ROWS = 50_000


def coarse_cells(chromosomes_a: int, chromosomes_b: int, polarized: bool, grid: int = GRID) -> list[tuple[int, int, int, float]]:
    """(i, j, block, share) of every unmasked cell of an unfolded spectrum: where folding puts it, and with what share."""
    total, out = chromosomes_a + chromosomes_b, []
    for i in range(chromosomes_a + 1):
        for j in range(chromosomes_b + 1):
            if i + j in (0, total):
                continue
            mirror = (chromosomes_a - i, chromosomes_b - j)
            if polarized or 2 * (i + j) < total:
                targets = [(i, j)]
            else:
                targets = [(i, j), mirror] if 2 * (i + j) == total else [mirror]
            for x, y in targets:
                block = x * grid // (chromosomes_a + 1) * grid + y * grid // (chromosomes_b + 1)
                out.append((i, j, block, 1.0 / len(targets)))
    return out


class LibrarySearch:
    """Spectra and library prepared for searches.

    ``library`` has rows (model, param_id, i, j, expected) for whole spectra. It is read once for coarse totals, once for
    the envelopes of a search, and again for the entries that are scored.
    """

    def __init__(
        self, cells: DataFrame, library: DataFrame, chromosomes_a: int, chromosomes_b: int, keys: list[str] = PAIR,
        *, polarized: bool = False, grid: int = GRID,
    ):
        self.library, self.sizes, self.keys, self.polarized = library, (chromosomes_a, chromosomes_b), keys, polarized
        data = materialize(fold_spectra(cells, chromosomes_a, chromosomes_b, keys, polarized=polarized).filter("mass > 0"))
        facts = data.groupBy(*keys).agg(
            F.sum("mass").alias("data_total"), F.sum(log_gamma1p(F.col("mass"))).alias("constant"), F.count("*").alias("data_cells")
        )
        shuffled = F.xxhash64(*keys)
        numbered = bucketed_rank(facts, [], [F.pmod(shuffled, F.lit(_SLOT_BUCKETS))], [shuffled, *map(F.col, keys)], "slot")
        self.facts = materialize(numbered.withColumn("slot", F.col("slot") - 1))
        self.data = materialize(data.join(self.facts.select(*keys, "slot"), keys).select("slot", "i", "j", "mass"))

        # one row per entry with a column per block; a raw cell counts where folding puts it
        places = coarse_cells(chromosomes_a, chromosomes_b, polarized, grid)
        blocks = sorted({block for _, _, block, _ in places})
        table = F.broadcast(cells.sparkSession.createDataFrame(places, "i long, j long, block int, share double"))
        met = library.select(*ENTRY, "i", "j", "expected").join(table, ["i", "j"])
        part = F.col("expected") * F.col("share")
        totals = met.groupBy(*ENTRY).agg(
            F.sum(part).alias("model_total"), *[F.sum(F.when(F.col("block") == b, part).otherwise(0.0)).alias(f"_m{b}") for b in blocks]
        )
        logs = [F.log(F.greatest(F.col(f"_m{b}") / F.col("model_total"), F.lit(_LEAST))) for b in blocks]
        shape = [F.xxhash64(*[F.floor(x / step) for x in logs]).alias(f"_s{k}") for k, step in enumerate(STEPS)]
        self.totals = materialize(totals.filter("model_total > 0").select(*ENTRY, "model_total", *shape))

    def _clusters(self, parts: DataFrame, by: list[str]) -> DataFrame:
        """entry, ``by``, model_total and cluster of every entry of ``parts``."""
        more = [c for c in by if c not in ENTRY]
        own = self.totals.join(parts.select(*ENTRY, *more).hint("merge"), ENTRY, "inner" if more else "left_semi")
        shapes = [f"_s{k}" for k in range(len(STEPS))]
        sizes = own.agg(F.count("*"), *[F.approx_count_distinct(F.xxhash64(*by, s)) for s in shapes]).first()
        fine = [s for s, n in zip(shapes, sizes[1:]) if n * ENTRIES_PER_CLUSTER <= sizes[0]]
        return own.select(*dict.fromkeys([*ENTRY, *by]), "model_total", F.xxhash64(*by, fine[-1] if fine else shapes[0]).alias("cluster"))

    def _bounds(self, entries: DataFrame) -> DataFrame:
        """cluster, _group and the bound of each lane's spectrum; null where the cluster expects nothing in a cell with data."""
        raw = self.library.join(entries.select(*ENTRY, "model_total", "cluster").hint("merge"), ENTRY)
        share = F.max(F.col("expected") / F.col("model_total")).alias("share")
        # folded sums of envelopes are no less than envelopes of folded sums
        envelope = fold_spectra(raw.groupBy("cluster", "i", "j").agg(share), *self.sizes, ["cluster"], value="share", polarized=self.polarized)
        logs = materialize(envelope.filter("share > 0").select("cluster", "i", "j", F.log("share").alias("log_share")))
        lanes = range(_LANES)
        lane = F.col("slot") % _LANES
        packed = self.data.groupBy(F.floor(F.col("slot") / _LANES).alias("_group"), "i", "j").agg(
            *[F.sum(F.when(lane == k, F.col("mass")).otherwise(0.0)).alias(f"_w{k}") for k in lanes]
        )
        held = self.facts.groupBy(F.floor(F.col("slot") / _LANES).alias("_group")).agg(
            *[F.max(F.when(lane == k, F.col("data_cells"))).alias(f"_c{k}") for k in lanes]
        )
        met = logs.join(broadcast_if_small(materialize(packed), _SPECTRA_ROWS), ["i", "j"]).groupBy("cluster", "_group").agg(
            *[F.sum(F.col(f"_w{k}") * F.col("log_share")).alias(f"_x{k}") for k in lanes],
            *[F.count_if(F.col(f"_w{k}") > 0).alias(f"_n{k}") for k in lanes],
        )
        whole = [F.when(F.col(f"_n{k}") == F.col(f"_c{k}"), F.col(f"_x{k}")).alias(f"_u{k}") for k in lanes]
        return materialize(met.join(broadcast_if_small(held, _SPECTRA_ROWS), "_group").select("cluster", "_group", *whole))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """slot, model, param_id, log_likelihood and theta of the pairs (slot, model, param_id), by all cells.

        Spectra and entries meet as arrays over the cells in one order, so a pair stays one row.
        """
        wanted = materialize(pairs.select(*ENTRY).distinct())
        wanted = F.broadcast(wanted) if fits_in_broadcast(wanted, _SPECTRA_ROWS) else wanted.hint("merge")
        raw = self.library.join(wanted, ENTRY, "left_semi").select(*ENTRY, "i", "j", "expected")
        expected = fold_spectra(raw, *self.sizes, ENTRY, value="expected", polarized=self.polarized)
        cells = [i * (self.sizes[1] + 1) + j for i in range(self.sizes[0] + 1) for j in range(self.sizes[1] + 1)]
        cell = (F.col("i") * (self.sizes[1] + 1) + F.col("j")).cast("int")

        def arrays(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
            held = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(cell, value))).alias("held"))
            order = F.array(*[F.lit(c) for c in cells])
            return held.select(*by, F.transform(order, lambda c: F.try_element_at("held", c)).alias(name))

        logs = arrays(expected.filter("expected > 0"), ENTRY, F.log("expected"), "logs")
        data = arrays(self.data, ["slot"], F.col("mass"), "masses")
        met = pairs.select("slot", *ENTRY).join(broadcast_if_small(data, _SPECTRA_ROWS), "slot").join(logs.hint("merge"), ENTRY, "left")
        # null where the spectrum has data and the entry expects nothing
        terms = F.zip_with("masses", "logs", lambda d, x: F.when(d.isNull(), F.lit(0.0)).otherwise(d * x))
        cross = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
        full = met.select("slot", *ENTRY, cross.alias("cross")).join(broadcast_if_small(self.facts, _SPECTRA_ROWS), "slot").join(
            self.totals.select(*ENTRY, "model_total").hint("merge"), ENTRY
        )
        theta = F.col("data_total") / F.col("model_total")
        ll = F.col("cross") + F.col("data_total") * F.log(theta) - F.col("data_total") - F.col("constant")
        return full.select("slot", *ENTRY, F.coalesce(ll, F.lit(float("-inf"))).alias("log_likelihood"), theta.alias("theta"))

    def candidates(self, parts: DataFrame, by: list[str], tie: float = TIE) -> DataFrame:
        """slot, model, param_id and ``by`` of the entries that are scored: all that can be the best of their part.

        ``parts`` gives (model, param_id) the columns ``by``: the best entry is wanted for each spectrum and part.
        """
        lanes = range(_LANES)
        entries = materialize(self._clusters(parts, by))
        first = F.min(F.struct("param_id", *[c for c in dict.fromkeys([*ENTRY, *by]) if c != "param_id"])).alias("first")
        clusters = entries.groupBy("cluster").agg(first)
        bounds = self._bounds(entries).join(clusters.hint("merge"), "cluster").select(
            "*", *[F.col(f"first.{c}").alias(c) for c in by]
        )
        # an entry of the cluster with the highest bound; where no cluster has one, the entry with the smallest id
        order = [F.struct(F.coalesce(f"_u{k}", F.lit(float("-inf"))).alias("u"), (-F.col("first.param_id")).alias("k")) for k in lanes]
        best = bounds.groupBy(*by, "_group").agg(*[F.max_by("first", order[k]).alias(f"_s{k}") for k in lanes])
        seeds = self._lanes(best, by, F.array(*[F.col(f"_s{k}") for k in lanes]), "entry")
        seeds = materialize(seeds.select("slot", *by, *[F.col(f"entry.{c}") for c in ENTRY if c not in by]))
        # bounds lack the constants of the spectrum, so these are taken off the score
        least = seeds.join(self.scores(seeds), ["slot", *ENTRY]).join(self.facts, "slot").withColumn(
            "least", F.col("log_likelihood") - self._constants() - tie - 1e-9 * F.abs("log_likelihood")
        )
        packed = least.groupBy(*by, F.floor(F.col("slot") / _LANES).alias("_group")).agg(
            *[F.max(F.when(F.col("slot") % _LANES == k, F.col("least"))).alias(f"_t{k}") for k in lanes]
        )
        met = bounds.join(broadcast_if_small(materialize(packed), _SPECTRA_ROWS), [*by, "_group"])
        # a cluster without a bound can't be better than -inf, so it counts only where nothing else is found
        marks = F.array(*[F.coalesce(F.coalesce(F.col(f"_u{k}"), F.lit(float("-inf"))) >= F.col(f"_t{k}"), F.lit(False)) for k in lanes])
        reached = self._lanes(met.filter(F.exists(marks, lambda m: m)), ["cluster"], marks, "reached").filter("reached")
        return reached.select("slot", "cluster").join(entries.drop("model_total").hint("merge"), "cluster").drop("cluster")

    @staticmethod
    def _lanes(rows: DataFrame, keep: list[str], values: Column, name: str) -> DataFrame:
        spread = rows.select(*keep, "_group", F.posexplode(values).alias("_lane", name)).filter(F.col(name).isNotNull())
        return spread.select((F.col("_group") * _LANES + F.col("_lane")).alias("slot"), *keep, name)

    @staticmethod
    def _constants() -> Column:
        """What a log-likelihood has besides sum d ln q."""
        d = F.col("data_total")
        return d * F.log(d) - d - F.col("constant")

    def best(self, parts: DataFrame, by: list[str], tie: float = TIE) -> DataFrame:
        """keys, ``by``, param_id, log_likelihood and theta of the best entry for each spectrum and part.

        Of entries whose log-likelihoods differ from the best one by at most ``tie`` the smaller id is taken. Where every
        entry of a part expects nothing in a cell with data, the smallest id comes with -inf.
        """
        found = materialize(self.candidates(parts, by, tie))
        scored = materialize(found.join(self.scores(found).hint("merge"), ["slot", *ENTRY]))
        return best_of(scored, ["slot", *by], tie).join(self.facts.select("slot", *self.keys), "slot").select(
            *self.keys, *by, *[c for c in ("param_id",) if c not in by], "log_likelihood", "theta"
        )


def best_of(scored: DataFrame, by: list[str], tie: float = TIE) -> DataFrame:
    """The best scored entry per ``by``; of those within ``tie`` of the best one the smaller id."""
    top = scored.groupBy(*by).agg(F.max("log_likelihood").alias("_top"))
    near = scored.join(top, by).filter((F.col("log_likelihood") >= F.col("_top") - tie) | (F.col("log_likelihood") == F.col("_top")))
    best = near.groupBy(*by).agg(F.min(F.struct("param_id", "log_likelihood", "theta")).alias("best"))
    return best.select(*by, *[F.col(f"best.{c}").alias(c) for c in ("param_id", "log_likelihood", "theta") if c not in by])


def best_entries(
    cells: DataFrame, library: DataFrame, chromosomes_a: int, chromosomes_b: int, keys: list[str] = PAIR,
    *, polarized: bool = False, tie: float = TIE,
) -> DataFrame:
    """keys, model, param_id, log_likelihood and theta: the best entry of each model for each spectrum."""
    search = LibrarySearch(cells, library, chromosomes_a, chromosomes_b, keys, polarized=polarized)
    return search.best(search.totals.select(*ENTRY), ["model"], tie)


def profile_scan(
    cells: DataFrame, library: DataFrame, parameters: DataFrame, parameter: str, chromosomes_a: int, chromosomes_b: int,
    keys: list[str] = PAIR, *, model: str = "asymmetric_migration", polarized: bool = False,
) -> DataFrame:
    """Best log-likelihood at each fixed value of one parameter, over all the others: keys, fixed_value, log_likelihood."""
    if parameter not in ("m_a_to_b", "m_b_to_a"):
        raise ValueError("profiles run along m_a_to_b or m_b_to_a.")
    fixed = materialize(parameters.filter(F.col("model") == model).select(*ENTRY, F.col("params")[parameter].alias("fixed_value")))
    search = LibrarySearch(cells, library.filter(F.col("model") == model), chromosomes_a, chromosomes_b, keys, polarized=polarized)
    return search.best(fixed, ["fixed_value"]).select(*keys, "fixed_value", "log_likelihood")
