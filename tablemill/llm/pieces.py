"""SentencePiece encoding and decoding by a parallel max-plus scan.

A text's segmentation is the path of the greatest summed piece score.  A giant text is cut into chunks
of fixed length.  A state at a cut is how far a piece reaches over it, so a chunk is a matrix of best
scores from the state at its start to the state at its end.  Max-plus products of these matrices are
associative: a prefix scan gives the best scores at every cut.  Then each chunk finds, on its own, the
state at its start that each state at its end comes from; following these maps from the end fixes all
states, and every chunk is traced back independently.

The score model is the unigram one: pieces and scores are taken from the model file, characters without
a piece are spelt in bytes, and of equally good paths the one with the earlier start of the last piece
is taken, going back from the end.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import slices
from tablemill.session import stage

CHUNK = 65_536
#: Stretches that a task remembers, characters of texts that it encodes at once, longest stretch that is
#: solved together with others, and cells (stretch by place) of one such turn.
KEEP, SLICE, SHORT, CELLS = 300_000, 2_000_000, 64, 100_000
#: Multiplier of the hash of pieces, and bits of its table.
BASE, SLOTS = 0x9E3779B97F4A7C15, 20
#: The sign that stands for a blank in pieces, and what an unknown character costs below the least score.
BLANK, PENALTY = "▁", 10.0
NEVER = float("-inf")
UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Lattice:
    """Pieces of a model file, and the best paths over texts whose blanks are already written as pieces do."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(model.get_piece_size())]
        self.piece = [model.id_to_piece(i) for i in range(len(kinds))]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(len(kinds)) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.score = {p: (model.get_score(i), i) for i, p in enumerate(self.piece) if not kinds[i] and i not in self.of_byte}
        self.longest = max(map(len, self.score))
        #: pieces and, with None, all that pieces begin with, so that a search ends where no piece goes on
        self.find = {p[:n]: None for p in self.score for n in range(1, len(p))} | self.score
        self.unknown = min(s for s, _ in self.score.values()) - PENALTY
        #: no piece goes on over a blank after another character, so texts can be cut there
        self.cuttable = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.score)
        #: score, ids as 32-bit numbers, and whether they decode to the stretch, of stretches met before in chunks
        self.known: dict[str, tuple[float, bytes, bool]] = {}
        self._table()
        self._forget()

    def _forget(self) -> None:
        #: stretches met before: their numbers, and where their ids begin in ``ids``
        self.number: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _table(self) -> None:
        """A hash table of the pieces: first piece of each slot, the next one of the same slot, score, id and code points."""
        text = list(self.score)
        self.codes = np.zeros((len(text), self.longest), dtype=np.uint32)
        for row, piece in zip(self.codes, text, strict=True):
            row[: len(piece)] = [ord(c) for c in piece]
        self.size = np.array([len(p) for p in text])
        self.worth, self.id = np.array([self.score[p][0] for p in text]), np.array([self.score[p][1] for p in text], dtype=np.int32)
        self.hash = np.zeros(len(text), dtype=np.uint64)
        for n in range(self.longest):
            own = self.size > n
            self.hash[own] = self._add(self.hash[own], self.codes[own, n])
        self.first, self.next = np.full(1 << SLOTS, -1, dtype=np.int32), np.full(len(text), -1, dtype=np.int32)
        for i, slot in enumerate(self._slot(self.hash)):
            self.first[slot], self.next[i] = i, self.first[slot]

    @staticmethod
    def _add(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes + codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _solve(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each row has, whether they are known to be right) of stretches of one length, a row of code points each.

        All rows go through the scan together, place by place.  A row is not sure if a character has no
        piece, or if a piece of its path was taken for another by its hash.
        """
        rows, n = codes.shape
        found: list[np.ndarray] = []  # by length - 1: the piece that begins at each place, -1 for none
        hashes = np.zeros((rows, n), dtype=np.uint64)
        for length in range(1, min(n, self.longest) + 1):
            hashes = self._add(hashes[:, : n - length + 1], codes[:, length - 1 :])
            at = self.first[self._slot(hashes)]
            while True:
                other = (at >= 0) & ((self.hash[at] != hashes) | (self.size[at] != length))
                if not other.any():
                    break
                at[other] = self.next[at[other]]
            found.append(at)
        best, took = np.full((rows, n + 1), NEVER), np.zeros((rows, n + 1), dtype=np.int8)
        best[:, 0] = 0.0
        for j in range(1, n + 1):
            for length in range(min(j, self.longest), 0, -1):  # of equal paths the longest last piece
                at = found[length - 1][:, j - length]
                value = best[:, j - length] + np.where(at >= 0, self.worth[at], self.unknown if length == 1 else NEVER)
                better = value > best[:, j]
                best[better, j], took[better, j] = value[better], length
        sure, end, every = np.ones(rows, dtype=bool), np.full(rows, n), np.arange(rows)
        made, count = np.full((rows, n), -1, dtype=np.int32), np.zeros(rows, dtype=np.int64)
        step = 0
        while len(every):
            length = took[every, end[every]].astype(np.int64)
            begin = end[every] - length
            piece = np.empty(len(every), dtype=np.int64)
            for own in range(1, min(n, self.longest) + 1):
                these = np.flatnonzero(length == own)
                if len(these):
                    at = found[own - 1][every[these], begin[these]]
                    piece[these] = at
                    same = (self.codes[at, :own] == codes[every[these, None], begin[these, None] + np.arange(own)]).all(axis=1)
                    sure[every[these[~same | (at < 0)]]] = False
            made[every, n - 1 - step] = self.id[piece]
            count[every] += 1
            end[every] = begin
            every, step = every[begin > 0], step + 1
        return made[made >= 0] if sure.all() else made[sure][made[sure] >= 0], np.where(sure, count, 0), sure

    def _learn(self, words: list[str]) -> None:
        """Solve new stretches, those of one length together, and remember their ids."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word) if len(word) <= SHORT else 0, []).append(word)
        order, counts, ids = [], [], []
        for n, own in by_length.items():
            step = max(1, CELLS // n) if n else 1
            for at in range(0, len(own), step):
                part = own[at : at + step]
                if n:
                    codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), n)
                    made, count, sure = self._solve(codes)
                else:
                    made, count, sure = np.zeros(0, np.int32), np.zeros(len(part), np.int64), np.zeros(len(part), bool)
                order += [w for w, fine in zip(part, sure, strict=True) if fine]
                counts.append(count[sure])
                ids.append(made)
                for word in [w for w, fine in zip(part, sure, strict=True) if not fine]:
                    own_ids = np.frombuffer(self.unit(word)[1], dtype="<i4")
                    order.append(word)
                    counts.append(np.array([len(own_ids)]))
                    ids.append(own_ids)
        first = len(self.number)
        self.number.update(zip(order, range(first, first + len(order)), strict=True))
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(np.concatenate(counts))]
        self.ids = np.concatenate([self.ids, *ids])

    def encoded_together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        units = [self.units(t) for t in texts]
        if len(self.number) > KEEP:
            self._forget()
        new = set().union(*units).difference(self.number)
        if new:
            self._learn(sorted(new))
        number = self.number
        at = np.array([number[u] for own in units for u in own], dtype=np.int64)
        size = self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - size), size)]
        cuts = np.r_[0, ends][np.cumsum([len(own) for own in units])]
        return np.split(flat, cuts[:-1]) if len(cuts) else []

    def forward(self, text: str, body: int, begin: list[float]) -> tuple[list[float], list[int], list[int]]:
        """Best score, start and id of the last piece at every position, for pieces that start before ``body``.

        ``begin`` holds the scores with which the first positions are reached from outside.
        """
        size = len(text)
        best = begin + [NEVER] * (size + 1 - len(begin))
        start, last = [-1] * (size + 1), [-1] * (size + 1)
        find, longest, unknown = self.find.get, self.longest, self.unknown
        for i in range(min(body, size)):
            base = best[i]
            if base == NEVER:
                continue
            single = False
            for j in range(i + 1, (i + longest if i + longest < size else size) + 1):
                hit = find(text[i:j], 0)
                if hit:
                    single = single or j == i + 1
                    value = base + hit[0]
                    if value > best[j]:
                        best[j], start[j], last[j] = value, i, hit[1]
                elif hit == 0:  # no piece goes on from here
                    break
            if not single and base + unknown > best[i + 1]:
                best[i + 1], start[i + 1], last[i + 1] = base + unknown, i, -2
        return best, start, last

    def back(self, text: str, end: int, start: list[int], last: list[int]) -> tuple[int, list[int]]:
        """(where the path came in, its ids) of the best path to ``end``."""
        ids: list[int] = []
        while start[end] >= 0:
            i = start[end]
            ids += [last[end]] if last[end] >= 0 else [self.byte[b] for b in reversed(text[i:end].encode("utf-8", "surrogatepass"))]
            end = i
        return end, ids[::-1]

    def unit(self, text: str) -> tuple[float, bytes, bool]:
        """Score, ids and exactness of a stretch that no piece crosses."""
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= KEEP // 4:
                self.known.clear()
            best, start, last = self.forward(text, len(text), [0.0])
            ids = self.back(text, len(text), start, last)[1]
            found = best[-1], np.array(ids, dtype="<i4").tobytes(), self.decode(ids) == text
            if len(text) <= 64:
                self.known[text] = found
        return found

    def units(self, text: str) -> list[str]:
        return UNITS.findall(text) if self.cuttable else [text] if text else []

    def encoded(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids of a text and whether they decode to it; a text decodes if all its stretches do."""
        known, unit = self.known, self.unit
        found = [known.get(u) or unit(u) for u in self.units(text)]
        return np.frombuffer(b"".join([f[1] for f in found]), dtype="<i4"), all([f[2] for f in found])

    def encode(self, text: str) -> list[int]:
        return self.encoded(text)[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids, blanks still written as pieces do."""
        if not self.of_byte or self.of_byte.keys().isdisjoint(ids):
            return "".join([self.piece[i] for i in ids])
        raw = b"".join([bytes([self.of_byte[i]]) if i in self.of_byte else self.piece[i].encode() for i in ids])
        return raw.decode("utf-8", "replace")

    # chunks: ``text`` is the body and up to longest - 1 characters after it

    def _cuts(self, text: str, body: int) -> tuple[int, int] | None:
        """The first and the last place within the body that no piece crosses."""
        if not self.cuttable:
            return None
        places = [m.end() - 1 for m in re.finditer(f"[^{BLANK}]{BLANK}", text[:body])]
        return (places[0], places[-1]) if places else None

    def matrix(self, text: str, body: int) -> np.ndarray:
        """Best score from each reach at the chunk's start to each reach at its end."""
        m = self.longest
        out = np.full((m, m), NEVER)
        cuts = self._cuts(text, body)
        if cuts is None:
            for a in range(min(m, len(text) + 1)):
                if a >= body:  # the piece from before goes on beyond this chunk
                    out[a, a - body] = 0.0
                    continue
                best = self.forward(text, body, [NEVER] * a + [0.0])[0][body : body + m]
                out[a, : len(best)] = best
            return out
        first, final = cuts
        middle = sum(self.unit(u)[0] for u in self.units(text[first:final]))
        tail = self.forward(text[final:], body - final, [0.0])[0][body - final :][:m]
        for a in range(min(m, first + 1)):
            head = self.forward(text[:first], first, [NEVER] * a + [0.0])[0][first]
            out[a, : len(tail)] = head + middle + np.array(tail)
        return out

    def sources(self, text: str, body: int, begin: list[float]) -> list[int]:
        """For each reach at the chunk's end, the reach at its start that its best path comes from; -1 for none."""
        cuts = self._cuts(text, body)
        if cuts is not None:
            _, start, last = self.forward(text[: cuts[0]], cuts[0], begin[: cuts[0] + 1])
            return [self.back(text, cuts[0], start, last)[0]] * self.longest
        best, start, last = self.forward(text, body, begin[: len(text) + 1])
        ends = [body + b for b in range(self.longest)]
        return [self.back(text, e, start, last)[0] if e < len(best) and best[e] > NEVER else -1 for e in ends]

    def chunk_ids(self, text: str, body: int, begin: list[float], reach: int) -> tuple[int, list[int]]:
        """(reach at the start, ids of the pieces that start in the chunk), given the reach at its end."""
        cuts = self._cuts(text, body)
        if cuts is None:
            _, start, last = self.forward(text, body, begin[: len(text) + 1])
            return self.back(text, body + reach, start, last)
        first, final = cuts
        _, start, last = self.forward(text[:first], first, begin[: first + 1])
        came, ids = self.back(text, first, start, last)
        ids += self.encode(text[first:final])
        _, start, last = self.forward(text[final:], body - final, [0.0])
        return came, ids + self.back(text[final:], body - final + reach, start, last)[1]


@lru_cache(maxsize=1)
def lattice_of(path: str) -> Lattice:
    """The lattice of a file, read once in a Python worker."""
    return Lattice(path)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of matrices, with max for sum and sum for product."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """All products of the first 1, 2, ... matrices, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = max_plus(out[:-step], out[step:].copy())
        step *= 2
    return out


def encode_documents(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, ids array<int>, exact (decoding the ids gives the text back).

    A blank is put before the text, as the model file asks.  A null or empty text has no ids.  The sign
    that pieces use for a blank, inside a text, reads as a blank and makes exact false.  Texts of more
    than ``chunk`` characters are encoded in chunks, with the same ids.  Repeated rows are encoded each;
    further columns are ignored; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lattice = Lattice(path)  # read here only for the length of the longest piece
    longest = lattice.longest
    del lattice
    chunk = max(chunk, longest)
    # a blank goes before a text that is not empty
    giant = F.length(text) + 1 > chunk

    def short(batches):
        lattice = lattice_of(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices(texts, SLICE):
                shown = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts[part]]
                ids = lattice.encoded_together(shown)
                exact = [lattice.decode(i.tolist()) == s and BLANK not in (t or "") for i, s, t in zip(ids, shown, texts[part], strict=True)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)  # a slice has fewer than 2^31 characters
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                own = batch.column("doc_id").slice(part.start, len(ids))
                yield pa.RecordBatch.from_arrays([own, lists, pa.array(exact)], names=["doc_id", "ids", "exact"])

    made = "doc_id long, ids array<int>, exact boolean"
    few = docs.select("doc_id", "text").where(~giant).mapInArrow(short, made)

    shown = F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK)))
    rows = docs.where(giant).select("doc_id", shown.alias("s"), F.contains(text, F.lit(BLANK)).alias("odd"))
    giants = stage(rows.withColumn("row", F.monotonically_increasing_id()), "giants")
    # cut in one pass over the text; a chunk sees how the next one begins
    bodies = F.regexp_extract_all("s", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    cut = giants.select("row", bodies.alias("p")).select("row", "p", F.posexplode("p").alias("no", "own"))
    ahead = F.substring(F.coalesce(F.get("p", F.col("no") + 1), F.lit("")), 1, longest - 1)
    parts = cut.select("row", F.col("no").cast("long").alias("no"), F.length("own").alias("body"), F.concat("own", ahead).alias("s"))
    parts = stage(parts, "chunks")

    def matrices(batches):
        lattice = lattice_of(path)
        for batch in batches:
            values = [lattice.matrix(s, b).ravel() for s, b in zip(batch["s"], batch["body"], strict=True)]
            yield batch[["row", "no"]].assign(matrix=values)

    def begins(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        stack = np.array(group["matrix"].tolist()).reshape(-1, longest, longest)
        first = np.full(longest, NEVER)
        first[0] = 0.0
        return group[["row", "no"]].assign(begin=[first, *prefix_products(stack)[:-1, 0, :]])

    scanned = parts.repartition("row", "no").mapInPandas(matrices, "row long, no long, matrix array<double>").groupBy("row")
    entered = stage(parts.join(scanned.applyInPandas(begins, "row long, no long, begin array<double>"), ["row", "no"]), "entered")

    def maps(batches):
        lattice = lattice_of(path)
        for batch in batches:
            values = [lattice.sources(s, b, list(f)) for s, b, f in zip(batch["s"], batch["body"], batch["begin"], strict=True)]
            yield batch[["row", "no"]].assign(came=values)

    def reaches(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        out, now = [], 0
        for came in reversed(group["came"].tolist()):
            out.append(now)
            now = came[now]
        return group[["row", "no"]].assign(reach=out[::-1])

    mapped = entered.select("row", "no", "body", "s", "begin").mapInPandas(maps, "row long, no long, came array<int>").groupBy("row")
    ended = entered.join(mapped.applyInPandas(reaches, "row long, no long, reach int"), ["row", "no"])

    def trace(batches):
        lattice = lattice_of(path)
        for batch in batches:
            out = []
            for s, body, begin, reach in zip(batch["s"], batch["body"], batch["begin"], batch["reach"], strict=True):
                came, ids = lattice.chunk_ids(s, body, list(begin), reach)
                out.append((ids, lattice.decode(ids) == s[came : body + reach]))
            yield batch[["row", "no"]].assign(ids=[i for i, _ in out], exact=[e for _, e in out])

    traced = ended.select("row", "no", "body", "s", "begin", "reach").mapInPandas(trace, "row long, no long, ids array<int>, exact boolean")
    whole = traced.groupBy("row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda p: p["ids"])).alias("ids"), F.bool_and("exact").alias("exact")
    )
    many = giants.select("row", "doc_id", "odd").join(whole, "row").select("doc_id", "ids", (F.col("exact") & ~F.col("odd")).alias("exact"))
    return few.unionByName(many)


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, no ids the empty text."""

    def back(batches):
        lattice = lattice_of(path)
        for batch in batches:
            texts = [None if ids is None else lattice.decode(list(ids)).replace(BLANK, " ") for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [t if t is None else t[1:] if t[:1] == " " else t for t in texts]})

    return tokens.select("doc_id", "ids").mapInPandas(back, "doc_id long, text string")
