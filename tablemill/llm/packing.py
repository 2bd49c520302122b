"""Best-fit packing of documents into sequences by linear grouping.

Only the histogram of piece lengths (at most one count per possible length) reaches the driver.  The
plan made from it - which lengths share a sequence, and how often - is turned back into places for
actual documents by numbering the pieces of each length.

Linear grouping: large lengths are rounded up within groups of equal cardinality; the few rounded
sizes are packed by configurations (column generation on the covering program); the actual pieces
take the rounded places, and the rest fills what is left, best fit first.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import stage

if TYPE_CHECKING:
    import tiktoken

#: The pre-tokenizer pattern of this family of byte-level vocabularies (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the \s of the pattern matches; that of Python also takes the four separators \x1c to \x1f.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters of white space from which on a run is cut out: the faster library gives up on about a million.
LONG_RUN = 100_000
#: Share of each configuration whose pieces are left to best fit, which makes up for rounding up.
SPARE = 0.25


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in such a vocabulary: printable bytes are themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteIds:
    """Ids of whole texts by a byte-level BPE tokenizer file, whose vocabulary a faster library encodes.

    Special strings of the vocabulary inside a text become their ids, as the tokenizer file has it.  A
    null text has no ids.  Runs of white space of any length are read.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ranks = ranks
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")" if special else r"(\Z)")

    @cached_property
    def whole(self) -> tiktoken.Encoding:
        """Merges a text as one match of the pattern."""
        import tiktoken

        return tiktoken.Encoding("run", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[tuple[tiktoken.Encoding, str]]:
        """The text in parts that have the same ids as in the text, each with its coder.

        A match of the pattern always begins where a run of white space of two or more does, since no
        match goes from other characters into white space.  It takes the run but for the last character,
        or all of it before a special string and at the end; the next match begins behind it and does
        not look back.  So a long run is cut out there and is merged as the one match that it is.
        """
        for segment in self.special.split(text) if len(text) >= LONG_RUN else [text]:
            at = 0
            for run in BLANKS.finditer(segment) if len(segment) >= LONG_RUN else ():
                if run.end() - run.start() >= LONG_RUN:
                    stop = run.end() - (run.end() < len(segment))
                    yield self.coder, segment[at : run.start()]
                    yield self.whole, segment[run.start() : stop]
                    at = stop
            yield self.coder, segment[at:]

    def __call__(self, text: str | None) -> np.ndarray:
        ids = [coder.encode_to_numpy(part, allowed_special="all") for coder, part in self.parts(text or "")]
        return np.concatenate(ids).astype("<u4")


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on request, ids (array of int).

    A document is its ids and ``end_id``.  Documents above ``capacity`` are cut into pieces of that
    length, of which the first may be shorter.  part and place number the pieces of a length within
    the task that made them; the table must be stored before they are used.  A null text is empty.
    """

    def cut(batches):
        coder, seen = ByteIds(path), np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = np.concatenate([coder(text), end])
                n = len(own)
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    ids = (own[a:b].tolist(),) if keep_ids else ()
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(own[a:b]), task, seen[b - a], *ids))
                    seen[b - a] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", *(["ids"] if keep_ids else [])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
    return docs.select("doc_id", "text").mapInPandas(cut, schema + (", ids array<int>" if keep_ids else ""))


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The fill of one sequence that is worth most, by dynamic programming over its capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes, worth = sizes[order], worth[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gain = best[c - sizes[: fits[c]]] + worth[: fits[c]]
            top = int(gain.argmax())
            if gain[top] > best[c] + 1e-12:
                best[c], last[c] = gain[top], top
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    out = np.zeros(len(sizes))
    out[order] = pattern
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 600) -> list[tuple[np.ndarray, int]]:
    """Fills of a sequence and how often to use them, covering at most ``demand``: column generation, rounded down."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    for turn in range(most):
        if turn % 50 == 49:
            inverse = np.linalg.inv(columns)
        price = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, price, capacity)
        if value <= 1 + 1e-4:
            break
        enter, now = inverse @ pattern, inverse @ demand
        can = enter > 1e-9
        if not can.any():
            break
        ratio = np.where(can, np.maximum(now, 0) / np.where(can, enter, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        row = inverse[out] / enter[out]
        inverse -= np.outer(enter, row)
        inverse[out] = row
    left, chosen = demand.astype(np.int64).copy(), []
    times = np.linalg.solve(columns, demand.astype(float))
    for k in np.argsort(-times, kind="stable"):
        pattern = columns[:, k].astype(np.int64)
        used = pattern > 0
        count = min(int(times[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if count > 0:
            left -= count * pattern
            chosen.append((pattern, count))
    return chosen


class Plan:
    """Places for pieces, as runs: the next ``count`` pieces of a length go ``per`` to a sequence from ``offset`` on."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first place, per, first sequence, offset
        self.sequences = 0
        self.free: list[tuple[int, int, int]] = []  # room, first sequence, how many

    def put(self, length: int, count: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), per, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def keep_room(self, room: int, sequence: int, n: int) -> None:
        if n > 0 and room > 0:
            insort(self.free, (room, sequence, n))

    def fill(self, lengths: list[int], n: int) -> None:
        """Open ``n`` sequences that begin with the same lengths."""
        sequence, offset = self.open(n), 0
        for length in lengths:
            self.put(length, n, 1, sequence, offset)
            offset += length
        self.keep_room(self.capacity - offset, sequence, n)

    def best_fit(self, length: int) -> None:
        """Place all pieces left of a length, each in the sequence with the least room that holds it."""
        while self.left[length] > 0:
            at = bisect_left(self.free, (length, -1, -1))
            count = int(self.left[length])
            if at == len(self.free):
                per = self.capacity // length
                n = -(-count // per)
                self.free.insert(at, (self.capacity, self.open(n), n))
            room, sequence, n = self.free.pop(at)
            per = room // length
            whole = min(n, count // per)
            if whole:
                self.put(length, whole * per, per, sequence, self.capacity - room)
                self.keep_room(room - per * length, sequence, whole)
            if whole < n:
                rest = count - whole * per
                if rest:
                    self.put(length, rest, rest, sequence + whole, self.capacity - room)
                    self.keep_room(room - rest * length, sequence + whole, 1)
                    whole += 1
                self.keep_room(room, sequence + whole, n - whole)


def plan_packing(counts: np.ndarray, capacity: int, groups: int = 32, small: float = 1 / 8) -> Plan:
    """A plan for ``counts[length]`` pieces of each length from 1 to ``capacity``.

    Actual pieces take all places of a configuration but its smallest; that one, with the small
    lengths, is filled best fit first, so that what rounding up has left free is used.
    """
    plan = Plan(counts, capacity)
    if plan.left[capacity]:
        plan.fill([capacity], int(plan.left[capacity]))
    large = [s for s in range(capacity - 1, int(capacity * small), -1) if plan.left[s]]
    total = int(plan.left[large].sum()) if large else 0
    if total:
        # groups of equal cardinality from the longest down; a length may be shared by two groups
        share = -(-total // groups)
        members, room = [[]], share
        for s in large:
            n = int(plan.left[s])
            while n:
                take = min(n, room)
                members[-1].append([s, take])
                n, room = n - take, room - take
                if not room:
                    members, room = [*members, []], share
        members = [m for m in members if m]
        sizes = np.array([m[0][0] for m in members])
        sizes, place = np.unique(sizes, return_inverse=True)
        stock: list[list] = [[] for _ in sizes]
        for m, k in zip(members, place, strict=True):
            stock[k] += m
        demand = np.array([sum(n for _, n in m) for m in stock])
        for pattern, count in configurations(sizes, demand, capacity):
            count = int(count * (1 - SPARE))
            slots = [k for k in np.argsort(-sizes) for _ in range(pattern[k])][:-1]
            if not slots:
                continue
            while count:
                # the longest stretch of sequences in which every slot keeps one actual length
                need = {k: slots.count(k) for k in set(slots)}
                n = min([count, *(max(1, stock[k][0][1] // need[k]) for k in need)])
                lengths = []
                for k in slots:
                    head = stock[k][0]
                    take = min(head[1], n) if n > 1 else 1
                    lengths.append(head[0])
                    head[1] -= take
                    if not head[1]:
                        stock[k].pop(0)
                plan.fill(lengths, n)
                count -= n
    for s in range(capacity - 1, 0, -1):
        plan.best_fit(s)
    return plan


def pack(pieces: DataFrame, capacity: int = 1024) -> tuple[DataFrame, Plan]:
    """(pieces with sequence_id and offset, the plan); ``pieces`` is a stored table of ``token_pieces``.

    The driver holds one count per length and the runs of the plan, whose number depends on the
    capacity and not on the number of documents.
    """
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = plan_packing(counts, capacity)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), (batch["base"] + batch["place"]).to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield batch.drop(columns=["part", "place", "n", "base"]).assign(
                sequence_id=run[:, 3] + nth // run[:, 2], offset=run[:, 4] + nth % run[:, 2] * length
            )

    kept = [f for f in pieces.schema if f.name not in ("part", "place")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    numbered = pieces.join(starts, ["part", "length"]).select(*pieces.columns, "n", "base")
    return numbered.mapInPandas(place, schema), plan


def packed_documents(docs: DataFrame, path: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Every document in sequences of at most ``capacity`` tokens; a row per piece with sequence_id and offset.

    Null or empty texts are one piece that holds the end id.  Repeated rows are packed each; an empty
    table gives an empty table; further columns are ignored.
    """
    pieces = stage(token_pieces(docs, path, capacity, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity)[0]


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
