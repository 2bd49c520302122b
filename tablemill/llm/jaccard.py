"""N-gram Jaccard join by MinHash banding.

Texts that are equal form one class and are compared once.  Each class has a MinHash signature cut
into bands; the numbers of bands and rows follow from the similarity and the wanted recall.  Classes
that share a band hash are tied to the bucket's first class and the ties are gathered into candidate
components.  Within a component all pairs are verified on their full n-gram sets.  Where that takes more
copies of texts than its buckets would, as in long chains, the classes of each bucket are verified instead
and a pair counts in the first band it shares.  Either way pairs meet in blocks of bounded size and
through an inverted index, so that no list of pairs is ever written out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import BASE, KIND, Powers
from tablemill.llm.graph import components
from tablemill.session import stage

#: Bounds of a block of classes that are compared in one go.
BLOCK_ROWS = 2048
BLOCK_WORDS = 1_000_000
RUN = 1_000_000


def banding(similarity: float, recall: float, most: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows a band that reach the recall at the similarity with at most so many hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 0.999999))), 1)
    for rows in range(2, most + 1):
        chance = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-min(chance, 0.999999)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct hashes of the word n-grams of texts.  Words are separated by white space of ASCII.

    A text of fewer words has one n-gram, of all its words; a text without words has none.
    """

    def __init__(self, n: int):
        self.n, self.powers = n, Powers()

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        word = np.r_[False, KIND[data] > 0, False]
        start, stop = np.flatnonzero(~word[:-1] & word[1:]), np.flatnonzero(word[:-1] & ~word[1:])
        with np.errstate(over="ignore"):
            words = mix(self.powers.hashes(data, start, stop) + (stop - start).astype(np.uint64))
            grams = np.zeros(len(words), dtype=np.uint64)
            for k in range(self.n):
                grams[: len(words) - k] += words[k:] * np.uint64(pow(BASE, 2 * k + 1, 1 << 64))
            grams = mix(grams)
        out = []
        for a, b in zip(np.r_[0, np.searchsorted(start, ends)[:-1]], np.searchsorted(start, ends), strict=True):
            if b - a >= self.n:
                out.append(np.unique(grams[a : b - self.n + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    short = sum(words[a + k] * np.uint64(pow(BASE, 2 * k + 1, 1 << 64)) for k in range(b - a))
                out.append(mix(np.array([short], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out

    def __call__(self, texts) -> list[np.ndarray]:
        """A sorted array of hashes for each text; null counts as empty."""
        out, waiting, size = [], [], 0
        for text in texts:
            text = text or ""
            if waiting and size + len(text) > RUN:
                out += self._run(waiting)
                waiting, size = [], 0
            waiting.append(text)
            size += len(text)
        return out + (self._run(waiting) if waiting else [])


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(3)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.weights = np.array([pow(BASE, k + 1, 1 << 64) for k in range(rows)], dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        small = (grams >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(small), 2048):
                x = small[at : at + 2048, None] * self.times + self.plus
                np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=0), out=least)
            keys = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.weights).sum(axis=1, dtype=np.uint64)
            return mix(keys + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(BASE)).view(np.int64)


def text_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): two 64-bit hashes stand for a text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.concat(F.lit("~"), text)).alias("k2")
    )


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def sign(batches):
        shingler, signer = Shingler(n), Signer(bands, rows)
        for batch in batches:
            grams = shingler(batch["text"])
            batch = batch.drop(columns="text")
            batch["words"] = [len(g) for g in grams]
            batch["bands"] = [signer(g) if len(g) else np.zeros(0, np.int64) for g in grams]
            yield batch

    return text_keys(docs).mapInPandas(sign, "doc_id long, k1 long, k2 long, words long, bands array<long>")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, per_mille: int):
    """Yield (i, js): for each i of ``left`` the j of ``right`` whose set is at least so similar, i itself left out."""
    grams = np.concatenate([sets[j] for j in right])
    owner = np.repeat(right, [len(sets[j]) for j in right])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    sizes = np.array([len(s) for s in sets])
    for i in left:
        low, high = np.searchsorted(grams, sets[i], side="left"), np.searchsorted(grams, sets[i], side="right")
        n = high - low
        low, n = low[n > 0], n[n > 0]
        if not len(n):
            continue
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        common = np.bincount(owner[at], minlength=len(sets))
        near = 1000 * common >= per_mille * (sizes[i] + sizes - common)
        near[i] = False
        js = np.flatnonzero(near & (common > 0))
        if len(js):
            yield i, js


def _verify(rows: pd.DataFrame, n: int, per_mille: int) -> pd.DataFrame:
    """Links within one block, or between two: (cid, root, links) per class that has any.

    In a bucket of band number ``no`` links of classes that share an earlier band are left to that band.
    """
    sets = Shingler(n)(rows["text"])
    no = rows["no"].iloc[0]
    earlier = np.stack(rows["bands"].to_numpy())[:, :no] if no > 0 else None
    block = rows["block"].to_numpy()
    same = block.min() == block.max()
    every = np.arange(len(rows))
    left, right = (every, every) if same else (every[block == block.min()], every[block == block.max()])
    root, links = every.copy(), np.zeros(len(rows), dtype=np.int64)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, js in linked(sets, left, right, per_mille):
        if earlier is not None:
            js = js[~(earlier[js] == earlier[i]).any(axis=1)]
        links[i] += len(js)
        if not same:
            links[js] += 1
        for j in js:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    cid = rows["cid"].to_numpy()
    has = np.flatnonzero(links)
    return pd.DataFrame({"cid": cid[has], "root": cid[[find(i) for i in has]], "links": links[has]})


def _groups(batches, keys: list[str]):
    """Runs of rows with equal keys, from batches that are sorted by them."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        marks = batch[keys].to_numpy()
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        bounds = np.r_[0, cuts, len(batch)]
        for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield batch.iloc[a:b]
        rest = batch.iloc[bounds[-2] :]
    if rest is not None and len(rest):
        yield rest


def _cells(members: DataFrame) -> DataFrame:
    """(cid, copy_id, k1, k2, cells, bands): where each class is verified, as (cell, no, blocks, block).

    A cell is a component (no is -1, bands are null) or a bucket of one; whichever copies fewer texts.  A class
    has one cell for each of its bands at most.
    """
    def size(df: DataFrame, *keys: str) -> DataFrame:
        n = F.count(F.lit(1))
        blocks = F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(F.sum("words") / BLOCK_WORDS)).cast("int")
        return df.groupBy(*keys).agg(n.alias("n"), blocks.alias("blocks"))

    comps = stage(size(members, "comp"), "comps")
    wide = comps.where("blocks > 1").select("comp", (F.col("n") * F.col("blocks")).alias("whole"))
    inside = members.join(wide, "comp").select("comp", "cid", "words", F.posexplode("bands").alias("no", "band"))
    buckets = stage(size(inside, "comp", "no", "band").where("n > 1"), "buckets")
    spent = buckets.groupBy("comp").agg(F.sum(F.col("n") * F.col("blocks")).alias("apart"))
    chained = stage(wide.join(spent, "comp").where("apart < whole").select("comp"), "chained")

    def cell(name: str, no: Column) -> Column:
        block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        return F.struct(F.col(name).alias("cell"), no.cast("int").alias("no"), "blocks", block.alias("block"))

    facts = ["cid", "copy_id", "k1", "k2"]
    whole = members.join(comps.select("comp", "blocks"), "comp").join(chained, "comp", "left_anti").select(
        *facts, F.array(cell("comp", F.lit(-1))).alias("cells"), F.lit(None).cast("array<bigint>").alias("bands"))
    dealt = inside.join(chained, "comp", "left_semi").join(buckets.select("comp", "no", "band", "blocks"), ["comp", "no", "band"])
    # one entry a band
    listed = dealt.groupBy("cid").agg(F.collect_list(cell("band", F.col("no"))).alias("cells"))
    return whole.unionByName(members.select(*facts, "bands").join(listed, "cid"))


def _classes(docs: DataFrame, n: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, ...) of every document and (cid, k1, k2, copy_id, n_links, root) of every different text."""
    bands, rows = banding(similarity, recall)
    signed = stage(_signed(docs, n, bands, rows), "signed")
    classes = stage(
        signed.groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("copy_id"), F.first("words").alias("words"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    # a band hash that one class has alone is of no use; the others tie their classes to the bucket's first
    banded = classes.select("cid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first < last")
    ties = banded.join(buckets.select("band", "first"), "band").where("cid <> first").select(F.col("cid").alias("a"), F.col("first").alias("b"))
    found = components(ties).withColumnsRenamed({"node": "cid", "root": "comp"})
    members = stage(classes.join(found, "cid"), "members")
    cells = _cells(members)
    # the text of one document of each class that has candidates
    wanted = cells.select("cid", "cells", F.col("bands").alias("own_bands"), F.col("copy_id").alias("own_id"), F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    keyed = text_keys(docs)
    own = F.col("doc_id").eqNullSafe(F.col("own_id"))
    met = keyed.join(wanted, own & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")))
    # a row that repeats comes once, from each task as well
    texts = met.groupBy("cid").agg(F.first("text").alias("text"), F.first("cells").alias("cells"), F.first("own_bands").alias("bands"))
    placed = texts.withColumn("c", F.explode("cells")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1)))
    pairs = placed.select(
        "c.cell", "c.no", F.least("c.block", "other").alias("low"), F.greatest("c.block", "other").alias("high"), "c.block", "cid", "text", "bands"
    )
    per_mille = round(1000 * similarity)

    def verify(batches):
        for group in _groups(batches, ["cell", "no", "low", "high"]):
            if group["low"].iloc[0] == group["high"].iloc[0] or group["block"].nunique() == 2:
                yield _verify(group, n, per_mille)

    sets = pairs.repartition("cell", "no", "low", "high").sortWithinPartitions("cell", "no", "low", "high", "cid")
    links = stage(sets.mapInPandas(verify, "cid long, root long, links long"), "links")
    joined = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "cid"})
    counted = links.groupBy("cid").agg(F.sum("links").alias("n_links")).join(joined, "cid")
    named = classes.select("cid", "k1", "k2", "copy_id").join(counted, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = stage(named, "named")
    return signed, named


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links.

    Texts are linked if their sets of word ``n``-grams have a Jaccard similarity of at least
    ``similarity``.  copy_id is the smallest id of the documents with the same text, class_id the
    smallest id of those that links connect, n_links the number of *different* texts the text is
    linked to.  ``recall`` is the chance that a pair at the similarity itself meets in a band; pairs
    above it, and pairs that a chain of meetings connects, meet more surely.

    Null and empty texts have no n-grams: they are copies of one another without links.  A text of fewer
    than ``n`` words has one n-gram, of all its words.  Repeated rows are rows of their own; a null id
    is kept, and is the class id only where every id is null.  Further columns are ignored; an empty
    table gives an empty table.
    """
    signed, named = _classes(docs, n, similarity, recall)
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(least, "root").select("k1", "k2", "copy_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id", "copy_id", "n_links")


def one_per_group(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one of the smallest id stays, once.

    Groups and odd inputs are those of ``near_duplicates``; all columns are returned as they are.
    """
    _, named = _classes(docs, n, similarity, recall)
    first = named.groupBy("root").agg(F.min(F.struct("copy_id", "k1", "k2")).alias("s"))
    first = first.select(F.col("s.copy_id").alias("__id"), F.col("s.k1").alias("__m1"), F.col("s.k2").alias("__m2"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.concat(F.lit("~"), text))})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__m1")) & (F.col("__k2") == F.col("__m2"))
    kept = keyed.join(first, same, "left_semi").dropDuplicates(["doc_id", "__k1", "__k2"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
