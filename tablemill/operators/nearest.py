"""Exact nearest rows over several numeric columns, without looking at all pairs.

Distinct vectors are dealt over the leaves of a k-d tree.  A leaf finds the nearest of its own; only
vectors whose last found neighbour is no nearer than the box of another leaf visit that one as well.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import stage

#: Vectors that a leaf is meant to hold, most leaves, and sampled vectors per leaf that the tree is built from.
LEAF, MOST, SAMPLES = 2_000, 16_384, 8
#: Visitors of a leaf that one task looks at.
VISITORS = 20_000


def split_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, threshold) of the nodes of a full binary tree, each cut at the median of its widest dimension."""
    dims, cuts = np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, np.inf)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        own = parts.pop(node)
        if len(own) > 1:
            dims[node] = np.ptp(own, axis=0).argmax()
            values = own[:, dims[node]]
            cuts[node] = np.median(values)
            if cuts[node] == values.min():  # the lower side holds at least one vector
                cuts[node] = min(values[values > cuts[node]], default=np.inf)
        low = own[:, dims[node]] < cuts[node]
        parts[2 * node], parts[2 * node + 1] = own[low], own[~low]
    return dims, cuts


def leaf_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), dtype=np.int64)
    for _ in range(len(dims).bit_length() - 1):
        node = 2 * node + (x[np.arange(len(x)), dims[node]] >= cuts[node])
    return node - len(dims)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, the columns added up one after the other."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += np.square(a[:, k, None] - b[None, :, k])
    return out


def _nearest(x: np.ndarray, other: np.ndarray, keys: list, k: int) -> list[list[tuple]]:
    """For each row of ``x`` its first k (distance, key) among the keys of the vectors of ``other``."""
    out: list[list[tuple]] = []
    for at in range(0, len(x), 256):
        far = _distances(x[at : at + 256], other)
        take = min(k, len(other))
        # a vector has one key at least: those no farther than the k-th vector hold the first k, ties included
        last = np.partition(far, take - 1, axis=1)[:, take - 1] if take else np.zeros(len(far))
        for row, limit in zip(far, last, strict=True):
            found = [(row[j], key) for j in np.flatnonzero(row <= limit) for key in keys[j]]
            out.append(sorted(found)[:k])
    return out


def _matrix(arrays) -> np.ndarray:
    return np.array([list(a) for a in arrays], dtype=np.float64)


def nearest_rows(df: DataFrame, key: str, columns: Sequence[str], k: int, leaf: int = LEAF) -> DataFrame:
    """(key, rank, neighbour, distance): the k nearest other rows by Euclidean distance, all if there are fewer.

    Ties go to the smaller key, of type long or string.  Rows in which a column is null, NaN or infinite take no part.
    Equal vectors are searched for once, however many rows have them.
    """
    known = df.select(F.col(key).alias("key"), F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in columns]).alias("x"))
    known = stage(known.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))), "nearest-rows")
    kind = dict(known.dtypes)["key"]
    # a row needs the k + 1 smallest keys of its own vector at most, and k of any other
    first = known.withColumn("rn", F.row_number().over(Window.partitionBy("x").orderBy("key"))).where(F.col("rn") <= k + 1)
    vectors = first.groupBy("x").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    vectors = stage(vectors.withColumn("cid", F.monotonically_increasing_id()), "nearest-vectors")
    n = vectors.count()
    depth = min(max(0, -(-n // leaf) - 1).bit_length(), MOST.bit_length() - 1)
    share = min(1.0, SAMPLES * 16 * (1 << depth) / max(n, 1))
    some = vectors.select("x") if share == 1.0 else vectors.select("x").sample(withReplacement=False, fraction=share, seed=3)
    sample = _matrix(r["x"] for r in some.limit(SAMPLES * 32 << depth).collect()).reshape(-1, len(columns))
    dims, cuts = split_tree(sample, depth)

    @F.pandas_udf("long")
    def leaf_number(x: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(_matrix(x).reshape(-1, len(columns)), dims, cuts))

    dealt = stage(vectors.withColumn("leaf", leaf_number("x")), "nearest-leaves")
    lists = f"distances array<double>, near array<{kind}>"

    def within(group: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(group["x"])
        found = _nearest(x, x, group["keys"].tolist(), k + 1)
        return group[["cid", "leaf", "x"]].assign(distances=[[d for d, _ in f] for f in found], near=[[key for _, key in f] for f in found])

    home = stage(dealt.groupBy("leaf").applyInPandas(within, f"cid long, leaf long, x array<double>, {lists}"), "nearest-home")
    sides = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("low", F.min), ("high", F.max))]
    boxes = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *sides).toPandas()  # at most MOST lines
    low, high = (boxes[[f"{n}{i}" for i in range(len(columns))]].to_numpy(dtype=np.float64) for n in ("low", "high"))
    names = boxes["leaf"].to_numpy()

    def reached(batches):
        for batch in batches:
            x = _matrix(batch["x"]).reshape(-1, len(columns))
            limit = np.array([d[k] if len(d) > k else np.inf for d in batch["distances"]])
            gaps = np.zeros((len(x), len(names)))
            for i in range(len(columns)):
                gaps += np.square(np.maximum(np.maximum(low[:, i] - x[:, i, None], x[:, i, None] - high[:, i]), 0))
            # with room for the rounding of sums
            row, box = np.nonzero((gaps <= limit[:, None] * (1 + 1e-9)) & (names != batch["leaf"].to_numpy()[:, None]))
            for at in range(0, len(row), 50_000):
                r, b = row[at : at + 50_000], box[at : at + 50_000]
                yield pd.DataFrame({"cid": batch["cid"].to_numpy()[r], "to": names[b], "x": batch["x"].to_numpy()[r]})

    visits = stage(home.mapInPandas(reached, "cid long, to long, x array<double>"), "nearest-visits")
    crowd = visits.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("turns"))

    def visited(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(_matrix(left["x"]), _matrix(right["x"]), right["keys"].tolist(), k + 1)
        return left[["cid"]].assign(distances=[[d for d, _ in f] for f in found], near=[[key for _, key in f] for f in found])

    # a leaf with many visitors meets them in several turns
    turned = visits.join(crowd, "to").withColumn("turn", F.pmod(F.xxhash64("cid"), F.col("turns"))).select("cid", F.col("to").alias("leaf"), "turn", "x")
    hosts = dealt.join(crowd, F.col("leaf") == F.col("to")).select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "x", "keys")
    more = turned.groupBy("leaf", "turn").cogroup(hosts.groupBy("leaf", "turn")).applyInPandas(visited, f"cid long, {lists}")
    every = home.select("cid", "distances", "near").unionByName(more)
    each = every.select("cid", F.explode(F.arrays_zip("distances", "near")).alias("z")).select("cid", F.col("z.distances").alias("d"), F.col("z.near").alias("near"))
    best = each.withColumn("rn", F.row_number().over(Window.partitionBy("cid").orderBy("d", "near"))).where(F.col("rn") <= k + 1)
    found = best.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("d", "near"))).alias("found")).join(vectors.select("cid", "x"), "cid")
    # Spark splits the rows of a vector that very many have
    met = known.join(found.select("x", "found"), "x").withColumn("found", F.slice(F.filter("found", lambda f: f["near"] != F.col("key")), 1, k))
    out = met.select("key", F.posexplode("found").alias("pos", "f"))
    return out.select(F.col("key").alias(key), (F.col("pos") + 1).alias("rank"), F.col("f.near").alias("neighbour"), F.sqrt("f.d").alias("distance"))
