"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample and split until their lists are balanced.  Every vector goes
to the list of its nearest centroid and, near a boundary, to those of others about as near.  Centroids
are searched through a neighbour graph held in memory.  A query opens the lists whose centroids are
within a ratio of its nearest one's distance.  Neighbouring lists share a cell, which is a task's work
and answers a query once; cells are dealt into blocks of bounded size, so a long list is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import stage

#: Rows that one task compares at a time, and queries with them.
BLOCK = 4096
#: Cosines that differ by less may be equal, and so many pairs of vectors are multiplied at a time to tell.
CLOSE, PAIRS = 1e-9, 65_536


@dataclass
class Index:
    """Unit centroids, their neighbour graph, and the centroids at which every search begins."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of about the ``beam`` nearest centroids of each unit vector, nearest first.

        A best-first walk for all rows at once: each step opens the best centroid of every row that is
        not yet open and keeps the best ones seen; it ends when all that are kept are open.
        """
        k = len(self.centroids)
        beam = min(beam, k)
        n = len(x)
        rows = np.arange(n)[:, None]
        near = x @ self.centroids[self.entries].T
        order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
        ids, sims = self.entries[order], np.take_along_axis(near, order, axis=1)
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.hstack([ids, np.full((n, pad), -1)])
            sims = np.hstack([sims, np.full((n, pad), -np.inf)])
        opened = ids < 0
        seen = np.zeros((n, k), dtype=bool)
        seen[rows, self.entries[None, :]] = True
        while True:
            best = np.where(opened, -np.inf, sims).argmax(axis=1)
            live = np.flatnonzero(~opened[np.arange(n), best])
            if not len(live):
                break
            node = ids[live, best[live]]
            opened[live, best[live]] = True
            new = self.graph[node]
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            found = np.where(fresh, np.einsum("id,ijd->ij", x[live], self.centroids[new]), -np.inf)
            every_id, every_sim = np.hstack([ids[live], new]), np.hstack([sims[live], found])
            every_open = np.hstack([opened[live], ~fresh])
            order = np.argsort(-every_sim, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(every_id, order, 1), np.take_along_axis(every_sim, order, 1)
            opened[live] = np.take_along_axis(every_open, order, 1)
        return ids, sims


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[a : a + 4096] @ centroids.T).argmax(axis=1) for a in range(0, len(x), 4096)])


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors; then lists above twice the mean share are split in two, repeatedly."""
    rng = np.random.default_rng(1)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]

    def fit(points: np.ndarray, start: np.ndarray, turns: int) -> np.ndarray:
        for _ in range(turns):
            own = nearest(points, start)
            sums = np.zeros_like(start)
            np.add.at(sums, own, points)
            size = np.linalg.norm(sums, axis=1)
            start = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], start)
        return start

    centroids = fit(x, centroids, rounds)
    most = 2.0 * len(x) / max(lists, 1)
    for _ in range(8):
        own = nearest(x, centroids)
        sizes = np.bincount(own, minlength=len(centroids))
        large = np.flatnonzero(sizes > max(most, 2))
        if not len(large):
            break
        split = []
        for c in large:
            points = x[own == c]
            split.append(fit(points, points[rng.choice(len(points), 2, replace=False)], 4))
        centroids = np.vstack([centroids[(sizes > 0) & (sizes <= max(most, 2))], *split])
    return centroids


def build_index(x: np.ndarray, lists: int, degree: int = 24) -> Index:
    centroids = balanced_centroids(x, lists)
    k = len(centroids)
    # the nearest centroids of each, and a few others so that no part of the graph is cut off
    sims = centroids @ centroids.T
    np.fill_diagonal(sims, -np.inf)
    close = np.argsort(-sims, axis=1, kind="stable")[:, : min(degree, max(k - 1, 1))]
    rng = np.random.default_rng(2)
    graph = np.hstack([close, rng.integers(0, k, (k, 4))])
    entries = rng.permutation(k)[: max(1, int(np.sqrt(k)))]
    return Index(centroids, graph, entries)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as array of double) of the vectors that take part, very large and very small ones scaled.

    Vectors that are null, empty or zero, or hold null or non-finite components, take none; nor do those
    whose number of components is not the most frequent one (the largest of those, if tied).
    """
    values = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    # a power of two changes no cosine; only vectors whose squares could leave the range of doubles are scaled
    largest = F.array_max(F.transform("embedding", F.abs))
    half = F.floor(F.log2(largest) / 2)
    scaled = F.transform("embedding", lambda v: v * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - F.floor(F.log2(largest))))
    scaled = F.when(largest.between(2.0**-300, 2.0**300), F.col("embedding")).otherwise(scaled)
    good = values.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))
    sizes = good.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max(F.struct("n", "size"))["size"].alias("size")).first()
    return good.where(F.size("embedding") == (top["size"] or 0)).select("vec_id", scaled.alias("embedding"))


def nearest_neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, list_rows: int = 128, most_lists: int = 4096,
                       sample: int = 40_000, replicas: float = 1.03, probes: float = 1.3, beam: int = 24, least_probes: int = 16,
                       most_probes: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    Nearness is the cosine in double precision, ties go to the smaller id, and a query is not its own
    neighbour.  Equal vectors form one class that is indexed once: of its ids only the ``k`` + 1
    smallest can ever be among a query's ``k`` nearest, so those stand for it, and no result is lost.
    Classes as near as one another (parallel vectors) go by their smallest ids wherever they are cut.
    The index is fitted on about ``sample`` classes chosen by a hash; every class is indexed.

    ``list_rows`` is the aimed size of a list and ``most_lists`` bounds the centroids that are held in
    memory.  ``replicas`` and ``probes`` are the distance ratios up to which a vector is copied to, and a
    query searches, further lists; a query searches at least ``least_probes``.  ``beam`` and ``most_probes``
    are how many centroids a search of the graph keeps for a vector and for a query.

    Vectors that take no part are described at ``usable``; rows that repeat an id with the same vector
    count once; fewer than ``k`` candidates give fewer rows; further columns are ignored; an empty
    table gives an empty table.
    """
    rows = usable(embeddings)
    spark = embeddings.sparkSession
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1)
    classes = stage(
        few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumns({"cid": F.monotonically_increasing_id(), "low": F.col("ids")[0]}),
        "vectors",
    )
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = int(min(1.0, sample / total) * 1_000_000)
    chosen = classes.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < share).select("embedding").toPandas()
    x = np.array((chosen if len(chosen) else classes.limit(1).select("embedding").toPandas())["embedding"].tolist(), dtype=np.float64)
    index = build_index(unit(x), int(min(most_lists, max(1, total // list_rows), max(1, len(x) // 8))))

    per_cell = max(1, BLOCK // list_rows)

    def lists_of(batches, ratio: float, keep: int, least: int, sizes: np.ndarray | None):
        """Each row once for every cell in which it is put into lists, or searches lists.

        Those are the lists whose centroid is at most ``ratio`` times as far as the nearest, at least
        ``least`` of them, and for a search as many as it takes to hold ``k`` others.  home is the nearest.
        """
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.iloc[a : a + 2048]
                ids, sims = index.search(unit(np.array(part["embedding"].tolist(), dtype=np.float64)), keep)
                far = np.sqrt(np.maximum(2 - 2 * sims, 0))
                taken = far <= ratio * far[:, :1] + 1e-9
                taken[:, :least] = True
                if sizes is not None:
                    own = sizes[np.maximum(ids, 0)]
                    taken |= np.cumsum(own, axis=1) - own <= k
                r, c = np.nonzero(taken & (ids >= 0))
                lists = ids[r, c]
                order = np.lexsort((lists, r))
                r, lists = r[order], lists[order]
                cell = lists // per_cell
                cuts = np.flatnonzero((np.diff(r) != 0) | (np.diff(cell) != 0)) + 1
                first = np.r_[0, cuts] if len(r) else np.zeros(0, np.int64)
                yield part.iloc[r[first]].assign(cell=cell[first], lists=np.split(lists, cuts) if len(r) else [], home=ids[r[first], 0])

    wanted = rows.where(F.col("vec_id") % every == 0).distinct()
    queries = stage(wanted.join(classes.select("embedding", "cid"), "embedding").select("vec_id", "cid"), "queries")
    asked = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "low", "embedding")
    schema = "cid long, low long, embedding array<double>, cell int, lists array<int>, home int"
    posted = stage(classes.select("cid", "low", "embedding").mapInPandas(lambda b: lists_of(b, replicas, beam, 1, None), schema), "lists")
    # how many vectors are nearest to each centroid: a number for each of a bounded number of lists
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for row in posted.where(F.col("cell") == F.floor(F.col("home") / per_cell)).groupBy("home").count().collect():
        sizes[row["home"]] = row["count"]
    opened = stage(asked.mapInPandas(lambda b: lists_of(b, probes, most_probes, least_probes, sizes), schema), "probes")
    # at most one count per cell: bounded by most_lists and the splits
    blocks = posted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asks = opened.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns"))
    shape = F.broadcast(blocks.join(asks, "cell"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = posted.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("turn", upto("turns"))
    asking = opened.join(shape, "cell").withColumn("turn", F.pmod(F.xxhash64("cid"), F.col("turns")).cast("int")).withColumn("block", upto("blocks"))

    def compare(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` + 1 nearest of each query among the vectors in the lists that it opened, ties by the smallest id."""
        out = [pd.DataFrame({"cid": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "low": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(q) and len(v):
            a, b = np.array(q["embedding"].tolist(), dtype=np.float64), np.array(v["embedding"].tolist(), dtype=np.float64)
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            others, low = v["cid"].to_numpy(), v["low"].to_numpy()
            row_of = lambda lists: (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(list(lists)))
            (q_row, q_list), (v_row, v_list) = row_of(q["lists"]), row_of(v["lists"])
            for one in np.intersect1d(q_list, v_list):
                rows, near = q_row[q_list == one], v_row[v_list == one]
                take = min(len(near), k + 1)
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    sims = (a[some] @ b[near].T) / na[some, None] / nb[near]
                    # all that are as near as the last one taken, but for rounding: which of them count, exact score and id say
                    i, j = np.nonzero(sims >= np.partition(sims, -take, axis=1)[:, -take, None] - CLOSE)
                    i, j = some[i], near[j]
                    score = np.concatenate([
                        (a[i[c : c + PAIRS]] * b[j[c : c + PAIRS]]).sum(axis=1) / (na[i[c : c + PAIRS]] * nb[j[c : c + PAIRS]]) for c in range(0, len(i), PAIRS)
                    ])
                    order = np.lexsort((others[j], low[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < take
                    i, j, score = i[first], j[first], score[first]
                    out.append(pd.DataFrame({"cid": q["cid"].to_numpy()[i], "other": others[j], "low": low[j], "score": score}))
        found = pd.concat(out, ignore_index=True).drop_duplicates(["cid", "other"])
        return found.sort_values(["cid", "score", "low", "other"], ascending=[True, False, True, True]).groupby("cid").head(k + 1)

    keys = ["cell", "block", "turn"]
    found = (
        asking.select(*keys, "cid", "embedding", "lists").groupBy(*keys)
        .cogroup(held.select(*keys, "cid", "low", "embedding", "lists").groupBy(*keys))
        .applyInPandas(compare, "cid long, other long, low long, score double")
    )
    # the nearest classes, then the nearest ids, of each class that is asked for
    best = Window.partitionBy("cid").orderBy(F.desc("score"), "low", "other")
    top = found.distinct().withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    spread = top.join(classes.select(F.col("cid").alias("other"), "ids"), "other").select("cid", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    spread = spread.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    answers = spread.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    listed = queries.join(answers, "cid").select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("vec_id")), 1, k).alias("near")
    )
    return listed.select("query_id", F.posexplode("near").alias("nth", "r")).select(
        "query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score")
    )
