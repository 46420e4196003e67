"""Multinomial draws from counters: exact, and the same however the work is split.

The units of a key stand in order at the leaves of a binary tree. A node with n draws gives its left half a binomial share,
with the left half's part of the node's members as the odds, and the rest to the right. The binomial is inverted at a
uniform that is a hash of (seed, key, replicate, level, place), so a node's share depends on nothing else: not on tasks,
nor on how many units a task holds, nor on other keys. The product of these splits is the multinomial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftway.operators.ranking import bucketed_rank
from driftway.session import materialize

# Levels of the tree below a bucket, so that a task holds 2**12 units of one key.
BUCKET_BITS = 12
# Replicates that a task draws for one bucket.
LANES = 16
# Half the width, in standard deviations, of the range in which a binomial is inverted; mass beyond is below 1e-30.
_REACH, _MORE = 12.0, 20.0
# Numbers that one inversion step holds.
_CELLS = 1 << 18


def uniforms(stream: int, replicate, level: int, place):
    """Numbers in (0, 1), one for each (replicate, place) of a level, from the 52 high bits of a mixed counter."""
    import numpy as np

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    own = mixed(np.uint64(stream) + replicate.astype(np.uint64))
    at = mixed(own + np.uint64(level << 40) + place.astype(np.uint64))
    return ((at >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def binomial(n, p, u):
    """The smallest k with P(X <= k) >= u for X binomial (n, p), for whole arrays."""
    import numpy as np

    out = np.where(p >= 1.0, n, 0).astype(np.int64)
    todo = np.flatnonzero((n > 0) & (p > 0.0) & (p < 1.0))
    mean = n[todo] * p[todo]
    reach = _REACH * np.sqrt(mean * (1.0 - p[todo])) + _MORE
    low = np.maximum(np.floor(mean - reach), 0).astype(np.int64)
    high = np.minimum(np.ceil(mean + reach), n[todo]).astype(np.int64)
    order = np.argsort(high - low, kind="stable")
    todo, low, high = todo[order], low[order], high[order]
    start = 0
    while start < len(todo):
        stop = len(todo)
        while stop - start > 1 and (stop - start) * int(high[stop - 1] - low[stop - 1] + 1) > _CELLS:
            stop = start + (stop - start) // 2
        some = todo[start:stop]
        k = low[start:stop, None] + np.arange(int((high[start:stop] - low[start:stop]).max()))
        inside = k < high[start:stop, None]
        ratio = np.where(inside, (n[some, None] - k) / (k + 1.0), 1.0)
        steps = np.where(inside, np.log(ratio) + np.log(p[some] / (1.0 - p[some]))[:, None], -np.inf)
        logs = np.concatenate([np.zeros((len(some), 1)), np.cumsum(steps, axis=1)], axis=1)
        summed = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        below = (summed < u[some, None] * summed[:, -1:]).sum(axis=1)
        out[some] = np.minimum(low[start:stop] + below, high[start:stop])
        start = stop
    return out


def descend(place, members, replicate, node, drawn, stream: int, top: int, low: int):
    """(replicate, place, draws) of the nodes of level ``low``, from the draws of nodes of level ``top``.

    ``place`` and ``members`` are the nodes of level ``low`` in rising order; ``replicate``, ``node`` and ``drawn`` the
    nodes of level ``top`` that have draws.
    """
    import numpy as np

    levels = {low: (place, members)}
    for level in range(low + 1, top + 1):
        below, counts = levels[level - 1]
        up, where = np.unique(below >> 1, return_inverse=True)
        levels[level] = (up, np.bincount(where, weights=counts, minlength=len(up)))

    def held(level, at):
        places, counts = levels[level]
        k = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[k] == at, counts[k], 0.0)

    for level in range(top, low, -1):
        share = held(level - 1, 2 * node) / held(level, node)
        left = binomial(drawn, share, uniforms(stream, replicate, level, node))
        replicate, node = np.concatenate([replicate, replicate]), np.concatenate([2 * node, 2 * node + 1])
        drawn = np.concatenate([left, drawn - left])
        some = drawn > 0
        replicate, node, drawn = replicate[some], node[some], drawn[some]
    return replicate, node, drawn


def multinomial_weights(
    units: DataFrame, keys: list[str], unit: list[str], count: str, replicates: int, seed: int,
    *, slots: list[Column] | None = None, bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """Bootstrap weights of counted units: (keys, unit, replicate, weight), zero weights left out.

    Drawing n members with replacement makes the unit totals multinomial with
    probabilities count / n, so loci that share a configuration are drawn as one
    unit. Units are ordered by their columns within a key; ``slots`` may give
    coarser values in the same order, for numbering (default: the first column).
    ``bucket_bits`` sets how many units a task holds and changes no draw.
    """
    if replicates < 2:
        raise ValueError("two replicates at least are needed.")
    counted = units.select(*keys, *unit, F.col(count).cast("long").alias("_count"))
    ranked = bucketed_rank(counted, keys, slots or [F.col(unit[0])], [F.col(u) for u in unit], "_ordinal")
    placed = ranked.withColumn("_ordinal", F.col("_ordinal") - 1)
    placed = materialize(placed.withColumn("_bucket", F.shiftright("_ordinal", bucket_bits)))
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k) for k in keys]))
    stream = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_stream")
    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // LANES))).alias("_chunk")
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_count").alias("_total")).select("*", stream, chunks)
    placed = placed.select("*", chunks)

    def type_of(name: str) -> str:
        return units.schema[name].dataType.simpleString()

    key_types = [f"`{k}` {type_of(k)}" for k in keys]
    unit_types = [f"`{u}` {type_of(u)}" for u in unit]

    def share_out(frame):
        """The draws of each bucket of a key, for the replicates of one chunk."""
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("_bucket", ignore_index=True)
        buckets, members = frame["_bucket"].to_numpy(np.int64), frame["_total"].to_numpy(np.int64)
        first = int(frame["_chunk"].iloc[0]) * LANES
        own = np.arange(first, min(first + LANES, replicates), dtype=np.int64)
        top = bucket_bits + int(buckets[-1]).bit_length()
        stream = int(frame["_stream"].iloc[0])
        replicate, node, drawn = descend(
            buckets, members.astype(float), own, np.zeros(len(own), np.int64), np.full(len(own), members.sum()), stream, top, bucket_bits
        )
        out = pd.DataFrame({"_bucket": node, "_stream": stream, "_chunk": frame["_chunk"].iloc[0], "replicate": replicate, "_drawn": drawn})
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out

    def draw_inside(members, drawn):
        """The draws of each unit of one bucket."""
        import numpy as np

        members = members.sort_values("_ordinal", ignore_index=True)
        ordinals = members["_ordinal"].to_numpy(np.int64)
        if len(drawn):
            replicate, node, weight = descend(
                ordinals, members["_count"].to_numpy(float), drawn["replicate"].to_numpy(np.int64), drawn["_bucket"].to_numpy(np.int64),
                drawn["_drawn"].to_numpy(np.int64), int(drawn["_stream"].iloc[0]), bucket_bits, 0,
            )
        else:
            replicate = node = weight = np.empty(0, np.int64)
        out = members.loc[np.searchsorted(ordinals, node), [*keys, *unit]].reset_index(drop=True)
        return out.assign(replicate=replicate, weight=weight)

    shares = totals.groupBy(*keys, "_chunk").applyInPandas(
        share_out, ", ".join([*key_types, "_bucket long", "_stream long", "_chunk int", "replicate int", "_drawn long"])
    )
    return (
        placed.groupBy(*keys, "_bucket", "_chunk")
        .cogroup(shares.groupBy(*keys, "_bucket", "_chunk"))
        .applyInPandas(draw_inside, ", ".join([*key_types, *unit_types, "replicate int", "weight long"]))
    )
