"""Hard-negative mining over blocks along a Hilbert curve.

Rows lie in Parquet as blocks: sorted by label and by the place of their widest dimensions on a Hilbert
curve, a few thousand rows a block, with the least and greatest value of every dimension for the block and
for each small zone in it.  Interval arithmetic on these zone maps bounds the scores that an anchor can
reach in a block.  A block is read for a set of anchors only if some of them could find there a row that
their windows still ask for; inside, the same bounds choose the zones that are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import stage

#: Dimensions that the curve runs through, and bits of each.
DIMS, BITS = 8, 7
#: Sums of products below this are exact as doubles; scores beyond a long count as the nearest long.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Sizes(NamedTuple):
    """How the work is cut; results do not depend on it."""

    block: int = 4096  # rows of a block
    zone: int = 256  # rows of a zone in it
    anchors: int = 1024  # anchors of a set
    maps: int = 1024  # block maps that are looked at together
    reads: int = 16  # blocks that are read for a set in one go
    probes: int = 2  # blocks that a set reads first, to learn what its windows need not look for any more


BLOCKS = "block long, low int, high int, width int, ids binary, labels binary, vectors binary, zones binary"
SETS = "part long, width int, ids binary, labels binary, vectors binary, lows binary, highs binary"
FOUND = "part long, anchor long, slot int, vec_id long, score long"


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of whole numbers below 2^bits (at most 63 bits in all).

    Level by level, from the coarsest bit: a set bit turns the lower bits of the first axis over, a clear
    one swaps them with the axis; what remains is read as a Gray code.
    """
    axes = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        lower = (1 << level) - 1
        for axis in range(len(axes)):
            on = (axes[axis] >> level) & 1 == 1
            swap = np.where(on, 0, (axes[0] ^ axes[axis]) & lower)
            axes[0] ^= np.where(on, lower, swap)
            axes[axis] ^= swap
    for axis in range(1, len(axes)):
        axes[axis] ^= axes[axis - 1]
    turned = np.zeros(axes.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    axes ^= turned
    place = np.zeros(axes.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            place = (place << 1) | ((axis >> level) & 1)
    return place


def whole(vectors: list, width: int | None = None) -> np.ndarray:
    """floor(256 x) of every component; shorter vectors end in zeros, longer ones than ``width`` are cut."""
    lengths = [len(v) for v in vectors]
    width = max(lengths, default=0) if width is None else width
    if set(lengths) == {width}:
        out = np.array(vectors, dtype=np.float64).reshape(len(vectors), width)
    else:
        out = np.zeros((len(vectors), width))
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v[:width]
    return np.floor(256.0 * out)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as longs: doubles where no sum can pass 2^53, else Python integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    safe = np.sqrt(EXACT / width) - 1
    big_a, big_b = np.abs(a).max(axis=1) > safe, np.abs(b).max(axis=1) > safe
    if not big_a.any() and not big_b.any():
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    out[np.ix_(~big_a, ~big_b)] = a[~big_a] @ b[~big_b].T
    wide = [[int(x) for x in row] for row in b]
    for i, row in enumerate(a):
        own = [int(x) for x in row]
        for j in np.flatnonzero(big_b) if not big_a[i] else range(len(b)):
            out[i, j] = min(max(sum(map(int.__mul__, own, wide[j])), LEAST), MOST)
    return out


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score of each anchor with any vector between rows of ``low`` and ``high``.

    Both are moved outwards by more than the error of the sums.
    """
    width = min(a.shape[1], low.shape[1])
    up, down = np.maximum(a[:, :width], 0), np.minimum(a[:, :width], 0)
    low, high = low[:, :width], high[:, :width]
    slack = 1e-12 * (np.abs(a[:, :width]) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _bytes(numbers: np.ndarray) -> bytes:
    """Whole numbers as shorts where they fit, else as doubles."""
    short = not numbers.size or np.abs(numbers).max() < 1 << 15
    return numbers.astype("<i2" if short else "<f8").tobytes()


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = "<i2" if len(data) == 2 * rows * width else "<f8"
    return np.frombuffer(data, dtype=kind).reshape(rows, width).astype(np.float64)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8")


def usable_rows(embeddings: DataFrame, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, embedding): one row per id, of rows without null or non-finite parts, labels shifted where the id says so."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    one = known.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("one"))
    label = F.col("one.label")
    moved = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label).cast("int")
    return one.select("vec_id", moved.alias("label"), F.col("one.embedding").alias("embedding"))


def spreads(rows: DataFrame) -> tuple[int, pd.DataFrame]:
    """(number of rows, one line per dimension with mean and deviation, widest first), in one pass."""

    def sums(batches):
        total: np.ndarray = np.zeros((3, 0))
        for batch in batches:
            v = np.clip(whole(batch["embedding"].tolist()), -1e100, 1e100)
            if v.shape[1] > total.shape[1]:
                total = np.pad(total, ((0, 0), (0, v.shape[1] - total.shape[1])))
            total[:, : v.shape[1]] += [np.full(v.shape[1], len(v)), v.sum(axis=0), (v * v).sum(axis=0)]
        if total.shape[1]:
            yield pd.DataFrame({"dim": range(total.shape[1]), "n": total[0], "s": total[1], "q": total[2]})

    made = rows.select("embedding").mapInPandas(sums, "dim int, n double, s double, q double")
    by_dim = made.groupBy("dim").agg(*(F.sum(c).alias(c) for c in "nsq")).toPandas()  # as many lines as a vector has parts
    by_dim["mean"] = by_dim["s"] / by_dim["n"]
    by_dim["deviation"] = np.sqrt(np.maximum(by_dim["q"] / by_dim["n"] - by_dim["mean"] ** 2, 0))
    return rows.count(), by_dim.sort_values(["deviation", "dim"], ascending=[False, True])


def lay_blocks(rows: DataFrame, block: int, zone: int) -> DataFrame:
    """The rows as stored blocks (see ``BLOCKS``), sorted by label and place on the curve."""
    count, spread = spreads(rows)
    chosen = spread.head(DIMS)
    dims, mean, deviation = (chosen[c].to_numpy() for c in ("dim", "mean", "deviation"))

    @F.pandas_udf("long")
    def place(v: pd.Series) -> pd.Series:
        if not len(dims):
            return pd.Series(np.zeros(len(v), dtype=np.int64))
        x = whole(v.tolist(), int(dims.max()) + 1)[:, dims]
        cells = (np.clip((x - mean) / np.maximum(deviation, 1e-9), -2, 1.999) + 2) * ((1 << BITS) / 4)
        return pd.Series(hilbert_places(cells, BITS))

    def packed(number: int, own: pd.DataFrame) -> pd.DataFrame:
        v, labels = whole(own["embedding"].tolist()), own["label"].to_numpy(dtype="<i4")
        starts = np.arange(0, len(v), zone)
        maps = np.concatenate([np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)])
        ids = own["vec_id"].to_numpy(dtype="<i8").tobytes()
        row = (number, int(labels.min()), int(labels.max()), v.shape[1], ids, labels.tobytes(), _bytes(v), _bytes(maps))
        return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    def pack(batches: Iterator[pd.DataFrame]):
        number, waiting = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            while len(waiting) >= block:
                yield packed(number, waiting.iloc[:block])
                number, waiting = number + 1, waiting.iloc[block:]
        if waiting is not None and len(waiting):
            yield packed(number, waiting)

    order = ["label", "__place", "vec_id"]
    parts = max(1, -(-count // (4 * block)))
    in_order = rows.withColumn("__place", place("embedding")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(in_order.drop("__place").mapInPandas(pack, BLOCKS), "negative-blocks")


def _top(anchor, slot, ids, found, k: int) -> np.ndarray:
    """Places of the first k of each (anchor, slot): greater scores first, then smaller ids."""
    order = np.lexsort((ids, -found.astype(object) if len(found) and found.min() == LEAST else -found, slot, anchor))
    a, s = anchor[order], slot[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[rank < k]


class Search:
    """Best k rows of each anchor and window, block by block; ``lows`` rise as rows are found.

    ``lows`` and ``highs`` hold a window per anchor and slot; one with low above high asks for nothing.
    With ``same`` rows of the anchor's own label are sought, else those of other labels.
    """

    def __init__(self, width: int, ids: bytes, labels: bytes, vectors: bytes, lows: bytes, highs: bytes, same: bool, k: int):
        self.ids, self.labels = _longs(ids), np.frombuffer(labels, dtype="<i4")
        n = len(self.ids)
        self.vectors = _matrix(vectors, n, width)
        self.lows, self.highs = _longs(lows).reshape(n, -1).copy(), _longs(highs).reshape(n, -1)
        self.same, self.k = same, k
        self.best = [np.zeros(0, np.int64) for _ in range(4)]

    def wanting(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(wanted, greatest): per anchor and map, whether a row within could lie in a window, and its greatest score.

        ``first`` and ``last`` are the least and greatest label of each map.
        """
        least, greatest = bounds(self.vectors, low, high)
        own = self.labels[:, None]
        fits = (first <= own) & (own <= last) if self.same else (first < own) | (own < last)
        lows, highs = self.lows.astype(np.float64), self.highs.astype(np.float64)
        hit = np.zeros(least.shape, dtype=bool)
        for slot in range(lows.shape[1]):
            asks = (self.lows[:, slot] <= self.highs[:, slot])[:, None]
            hit |= asks & (greatest >= lows[:, slot, None]) & (least <= highs[:, slot, None])
        return hit & fits, greatest

    def read(self, width: int, ids: bytes, labels: bytes, vectors: bytes, zones: bytes, zone: int) -> None:
        ids, labels = _longs(ids), np.frombuffer(labels, dtype="<i4")
        starts = np.arange(0, len(ids), zone)
        low, high = np.split(_matrix(zones, 2 * len(starts), width), 2)
        wanted, _ = self.wanting(low, high, np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts))
        rows = np.flatnonzero(np.repeat(wanted.any(axis=0), np.diff(np.r_[starts, len(ids)])))
        anchors = np.flatnonzero(wanted.any(axis=1))
        if not len(rows) or not len(anchors):
            return
        ids, labels, v = ids[rows], labels[rows], _matrix(vectors, len(ids), width)[rows]
        made = [self.best]
        for part in np.array_split(anchors, -(-len(anchors) // 128)):
            found = scores(self.vectors[part], v)
            admitted = ((self.labels[part, None] == labels) == self.same) & (self.ids[part, None] != ids)
            for slot in range(self.lows.shape[1]):
                inside = admitted & (found >= self.lows[part, slot, None]) & (found <= self.highs[part, slot, None])
                if len(rows) > self.k:
                    # at most the k greatest of a row, and their ties
                    floor = np.partition(np.where(inside, found, LEAST), -self.k, axis=1)[:, -self.k, None]
                    inside &= found >= floor
                i, j = np.nonzero(inside)
                made.append([part[i], np.full(len(i), slot), ids[j], found[i, j]])
        every = [np.concatenate(c) for c in zip(*made, strict=True)]
        kept = _top(*every, self.k)
        self.best = [c[kept] for c in every]
        anchor, slot, _, found = self.best
        last, starts = self.k - 1, max(0, len(anchor) - self.k + 1)
        at = last + np.flatnonzero((anchor[last:] == anchor[:starts]) & (slot[last:] == slot[:starts]))
        self.lows[anchor[at], slot[at]] = np.maximum(self.lows[anchor[at], slot[at]], found[at])

    def found(self, part: int) -> pd.DataFrame:
        anchor, slot, ids, found = self.best
        return pd.DataFrame({"part": np.full(len(anchor), part), "anchor": self.ids[anchor], "slot": slot.astype(np.int32), "vec_id": ids, "score": found})


def anchor_sets(blocks: DataFrame, every: int, k: int, sizes: Sizes) -> DataFrame:
    """Stored sets of anchors (ids divisible by ``every``) with one open window each.

    The window begins at the k-th score that an anchor's own block holds for it.
    """

    def sets(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in batch.itertuples():
                ids, labels = _longs(row.ids), np.frombuffer(row.labels, dtype="<i4")
                v = _matrix(row.vectors, len(ids), row.width)
                chosen = np.flatnonzero(ids % every == 0)
                for at in range(0, len(chosen), sizes.anchors):
                    own = chosen[at : at + sizes.anchors]
                    open_ = np.full((len(own), 1), LEAST, dtype="<i8")
                    one = Search(row.width, ids[own].tobytes(), labels[own].tobytes(), _bytes(v[own]), open_.tobytes(), (~open_).tobytes(), True, k)
                    one.read(row.width, row.ids, row.labels, row.vectors, row.zones, sizes.zone)
                    yield pd.DataFrame([(number, row.width, ids[own].tobytes(), labels[own].tobytes(), _bytes(v[own]), one.lows.tobytes(), one.highs.tobytes())],
                                       columns=[c.split()[0] for c in SETS.split(", ")])
                    number += 1

    # a block a row: few rows a batch
    return stage(blocks.repartition(F.col("block")).mapInPandas(sets, SETS), "negative-sets")


def block_maps(blocks: DataFrame, chunks: int, zone: int) -> DataFrame:
    """Stored rows of many blocks each with their zone maps, numbered by ``chunk``."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        width = int(group["width"].max())
        low, high = np.zeros((len(group), width)), np.zeros((len(group), width))
        for i, row in enumerate(group.itertuples()):
            zones = _matrix(row.zones, row.n, row.width)
            low[i, : row.width], high[i, : row.width] = zones[: row.n // 2].min(axis=0), zones[row.n // 2 :].max(axis=0)
        made = (group["chunk"].iloc[0], width, group["block"].to_numpy(dtype="<i8").tobytes(), group["low"].to_numpy(dtype="<i4").tobytes(),
                group["high"].to_numpy(dtype="<i4").tobytes(), _bytes(low), _bytes(high))
        return pd.DataFrame([made], columns=["chunk", "map_width", "blocks", "first", "last", "map_low", "map_high"])

    n = 2 * F.ceil(F.length("ids") / (8 * zone)).cast("int")
    dealt = blocks.select("block", "low", "high", "width", "zones", n.alias("n"), F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"))
    schema = "chunk long, map_width int, blocks binary, first binary, last binary, map_low binary, map_high binary"
    return stage(dealt.groupBy("chunk").applyInPandas(pack, schema), "negative-maps")


def chosen_blocks(sets: DataFrame, maps: DataFrame, chunks: int, same: bool, k: int, probes: int | None = None) -> DataFrame:
    """(part, block): the blocks that some anchor of a set may need, or the ``probes`` that promise most of its anchors most."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        parts, blocks, wants = [], [], []
        for row in group.itertuples():
            one = Search(row.width, row.ids, row.labels, row.vectors, row.lows, row.highs, same, k)
            names, first, last = _longs(row.blocks), np.frombuffer(row.first, dtype="<i4"), np.frombuffer(row.last, dtype="<i4")
            low, high = (_matrix(m, len(names), row.map_width) for m in (row.map_low, row.map_high))
            wanted, greatest = one.wanting(low, high, first, last)
            want = wanted.sum(axis=0)
            if probes:
                best = np.where(wanted, greatest, -np.inf).argmax(axis=1)
                want = np.bincount(best[wanted.any(axis=1)], minlength=len(names))
            named = np.flatnonzero(want) if not probes else np.argsort(-want, kind="stable")[:probes][np.sort(-want)[:probes] < 0]
            parts += [row.part] * len(named)
            blocks += names[named].tolist()
            wants += want[named].tolist()
        return pd.DataFrame({"part": np.array(parts, dtype=np.int64), "block": np.array(blocks, dtype=np.int64), "want": np.array(wants, dtype=np.int64)})

    met = sets.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(maps, "chunk")
    made = met.groupBy("part", "chunk").applyInPandas(choose, "part long, block long, want long")
    if probes:
        rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("want"), "block"))
        made = made.withColumn("rank", rank).where(F.col("rank") <= probes)
    return stage(made.select("part", "block"), "negative-reads")


def read_blocks(pairs: DataFrame, sets: DataFrame, blocks: DataFrame, buckets: int, zone: int, same: bool, k: int) -> DataFrame:
    """``FOUND``, stored: the best k rows of each anchor and slot in the blocks that its set reads."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        one = Search(row.width, row.ids, row.labels, row.vectors, row.lows, row.highs, same, k)
        for b in right.itertuples():
            one.read(b.width, b.ids, b.labels, b.vectors, b.zones, zone)
        return one.found(row.part)

    # sets and blocks are few wide rows: a task gets a set and the blocks of one bucket at a time
    dealt = pairs.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)))
    left = dealt.select("part", F.col("bucket").alias("turn")).distinct().join(sets, "part")
    right = dealt.join(blocks, "block").withColumnRenamed("part", "set")
    found = left.groupBy("part", "turn").cogroup(right.groupBy("set", "bucket")).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
    return stage(found.withColumn("rank", rank).where(F.col("rank") <= k), "negative-found")


def with_windows(sets: DataFrame, found: DataFrame, window) -> DataFrame:
    """The sets with new windows; ``window(lows, highs, rank, score)`` fills (anchors, slots) tables from what was found."""

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0].copy()
        ids = _longs(row["ids"])
        lows, highs = (_longs(row[c]).reshape(len(ids), -1) for c in ("lows", "highs"))
        order = np.argsort(ids)
        at = order[np.searchsorted(ids, right["anchor"].to_numpy(), sorter=order)]
        lows, highs = window(lows, highs, at, right["slot"].to_numpy(), right["rank"].to_numpy(), right["score"].to_numpy())
        row["lows"], row["highs"] = lows.astype("<i8").tobytes(), highs.astype("<i8").tobytes()
        return pd.DataFrame([row])

    return stage(sets.groupBy("part").cogroup(found.withColumnRenamed("part", "set").groupBy("set")).applyInPandas(fill, SETS), "negative-sets")


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   shift_every: int = 7, labels: int = 10, sizes: Sizes = Sizes()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: exact, whatever the blocks.

    Anchors are the rows whose id is divisible by ``every``; their positives are the first rows of the
    same label, their negatives for each positive the first rows of other labels with a score from
    ``low`` to ``high`` per cent of the positive's.  Ties go to the smaller vec_id.  Rows with a null id,
    label or vector, or a null or non-finite component, take no part; of rows that repeat an id the one
    of the smallest label, then vector, does; missing components of shorter vectors count as 0; a score
    beyond a long counts as the nearest long; other columns are not looked at; an empty table gives an
    empty table.  A hot label fills many blocks.
    """
    blocks = lay_blocks(usable_rows(embeddings, shift_every, labels), sizes.block, sizes.zone)
    count = max(1, blocks.count())
    chunks, buckets = -(-count // sizes.maps), -(-count // sizes.reads)
    maps = block_maps(blocks, chunks, sizes.zone)
    sets = anchor_sets(blocks, every, positives, sizes)

    def best(same: bool, k: int, probes: int | None = None) -> DataFrame:
        return read_blocks(chosen_blocks(sets, maps, chunks, same, k, probes), sets, blocks, buckets, sizes.zone, same, k)

    def negative_windows(lows, highs, at, slot, rank, score):
        lows, highs = np.full((len(lows), positives), MOST), np.full((len(lows), positives), LEAST)
        exact = [int(s) for s in score]
        lows[at, rank - 1] = [-(-low * s // 100) for s in exact]
        highs[at, rank - 1] = [high * s // 100 for s in exact]
        return lows, highs

    def raised(lows, highs, at, slot, rank, score):
        lows = lows.copy()
        last = rank == negatives
        lows[at[last], slot[last]] = np.maximum(lows[at[last], slot[last]], score[last])
        return lows, highs

    known = best(True, positives)
    sets = with_windows(sets, known, negative_windows)
    sets = with_windows(sets, best(False, negatives, sizes.probes), raised)
    found = best(False, negatives)
    near = known.select(F.col("anchor").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot"))
    far = found.select(F.col("anchor").alias("anchor_id"), "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_sql() -> str:
    """DuckDB SQL for the rows of ``hard_negatives`` with its defaults, for vectors of one length."""
    return """
        with u as (select vec_id, label, embedding from embeddings
                   where vec_id is not null and label is not null and embedding is not null and list_count(embedding) = len(embedding)
                     and coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)
                   qualify row_number() over (partition by vec_id order by label, embedding) = 1),
        v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                     list_transform(embedding, lambda x: floor(256 * x::double)) vec from u),
        s as (select a.vec_id anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.vec, b.vec)::bigint score
              from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        p as (select anchor_id, vec_id positive_id, score positive_score from s where same
              qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, row_number() over n::int as rank, vec_id negative_id, positive_score, score negative_score
        from p join s using (anchor_id)
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        window n as (partition by anchor_id, positive_id order by score desc, vec_id)
        qualify row_number() over n <= 3"""
