"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def sampled_labels(labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """About ``bound`` rows (doc_id, y) of the labelled rows that ``keep`` admits, chosen by a hash.

    The choice is a threshold on the hash of the id, so it is the same whenever it is computed.
    Ids with two different labels are left out; repeated equal labels count once.
    """
    known = (
        labels.where(keep & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("most"))
        .where("y = most")
        .select("doc_id", F.col("y").cast("int").alias("y"))
    )
    total = known.count()
    share = min(1.0, bound / max(total, 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text): one text for each id of the sample, the one whose hash is the least.

    However often an id repeats, it is one row; ``sample`` is small by its bound.
    """
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def slices(texts, size: int = 2_000_000):
    """Yield slices that cut ``texts`` into stretches of about ``size`` characters, one text at least."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= size:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


#: Kinds of bytes: 0 blank, 1 letter, digit, underscore or part of a longer character, 2 any other mark.
KIND = np.full(256, 2, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[ord(c) for c in "0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
KIND[128:] = 1
BASE = 0x9E3779B97F4A7C15
RUN = 500_000


class Powers:
    """Powers of a fixed odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A 64-bit polynomial hash of each stretch of the bytes."""
        return self.between(self.sums(data), start, stop)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            many = max(len(data), 2 * RUN)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(many, BASE, dtype=np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(many, pow(BASE, -1, 1 << 64), dtype=np.uint64)], dtype=np.uint64)
        with np.errstate(over="ignore"):
            return np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)]

    def between(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[stop] - sums[start]) * self.down[start]


class Terms:
    """Hashed terms of texts, computed for many texts at once.

    A term is a run of letters and digits, or a run of other marks.  Its hash is a polynomial in its
    UTF-8 bytes, taken as the difference of two running sums, so no text is cut into Python strings.
    With ``prefixes`` the first so many bytes of a longer term are terms of their own.
    """

    def __init__(self, size: int, lower: bool = False, prefixes: tuple[int, ...] = ()):
        self.size, self.lower, self.prefixes = size, lower, prefixes
        self.powers = Powers()

    def _ids(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        h = self.powers.between(sums, start, end) + np.uint64(salt)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(24)) % np.uint64(self.size)).astype(np.int64)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(place, id): for each term the place of its text in ``texts`` and its hashed id, in order."""
        raw = [((t or "").lower() if self.lower else t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        kind = KIND[data]
        edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(data) else np.zeros(0, np.int64)
        stop = np.r_[edge[1:], len(data)]
        full = kind[edge] > 0
        start, stop = edge[full], stop[full]
        with np.errstate(over="ignore"):
            sums = self.powers.sums(data)
            found = [self._ids(sums, start, stop, 0)]
            where = [start]
            for n in self.prefixes:
                longer = (stop - start > n) & (kind[start] == 1)
                found.append(self._ids(sums, start[longer], start[longer] + n, n))
                where.append(start[longer])
        return np.searchsorted(ends, np.concatenate(where), side="right"), np.concatenate(found)

    def runs(self, texts):
        """Yield (first, count, place, id) over runs of texts of bounded length.

        A text longer than a run comes in several runs, cut at blanks; its terms then carry the same place.
        """
        waiting, first, size = [], 0, 0
        for i, text in enumerate(texts):
            text = text or ""
            if waiting and size + len(text) > RUN:
                yield first, len(waiting), *self(waiting)
                waiting, first, size = [], i, 0
            while len(text) > RUN:
                cut = max(text.rfind(" ", 1, RUN), text.rfind("\n", 1, RUN))
                cut = cut if cut > 0 else RUN
                yield first, 1, *self([text[:cut]])
                text = text[cut:]
            waiting.append(text)
            size += len(text)
        if waiting:
            yield first, len(waiting), *self(waiting)


def log_sigmoid_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
