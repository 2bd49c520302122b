"""Toxicity: a factorization machine over hashed terms.

Terms are lower-case words and marks and the first letters of longer words.  A document is the set of
its terms.  The machine adds a weight per term and the inner product of two small vectors per pair of
terms, so a pair (an insult and the group it is aimed at) can weigh what neither term does alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import Terms, fold, sampled_labels, sampled_texts, sigmoid, slices
from tablemill.session import stage

SPACE = 1 << 20
#: Likelihood ratio from which a term tells the label, and tasks that the given terms are dealt over.
LEAST = 16.0
TURNS = 48
STRETCH = 1 << 20


def terms_of() -> Terms:
    return Terms(SPACE, lower=True, prefixes=(4, 5, 6))


def term_sets(texts, terms: Terms, column: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, columns): the distinct terms of each text, all texts behind one another.

    ``column`` maps term ids to the columns of a machine, -1 for terms that it does not use.
    """
    keys = [np.zeros(0, np.int64)]
    for first, _, place, ids in terms.runs(texts):
        if column is not None:
            ids = column[ids]
            place, ids = place[ids >= 0], ids[ids >= 0]
        keys.append(np.unique((place + first) * SPACE + ids))
    keys = np.unique(np.concatenate(keys))  # a long text comes in several runs
    return np.searchsorted(keys, np.arange(len(texts) + 1) * SPACE), keys % SPACE


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; empty runs are zero."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


@dataclass
class Machine:
    """Bias, weight per column and factor vector per column; ``column`` maps term ids to columns."""

    column: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, starts: np.ndarray, columns: np.ndarray) -> np.ndarray:
        own = self.factor[columns]
        total = _sums(own, starts)
        pairs = 0.5 * (total * total - _sums(own * own, starts)).sum(axis=1)
        return self.bias + _sums(self.weight[columns], starts) + pairs

    def score(self, texts, terms: Terms) -> np.ndarray:
        return sigmoid(self.logits(*term_sets(texts, terms, self.column)))


def _ratio(a, c, n1, n, odds=1.0):
    """Likelihood ratio of presence and label: ``a`` of ``c`` rows with a term, and ``n1`` of all ``n``, have the label.

    ``odds`` is the odds ratio that is expected of them.
    """
    total = n + (odds - 1) * (c + n1)
    e = 2 * odds * c * n1 / (total + np.sqrt(np.maximum(total * total - 4 * odds * (odds - 1) * c * n1, 0)))
    cells = [(a, e), (c - a, c - e), (n1 - a, n1 - e), (n - c - n1 + a, n - c - n1 + e)]
    return sum(2 * o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)) for o, e in cells)


@dataclass
class Screen:
    """What the counts of single terms say of ``n`` rows, ``n1`` of them labelled: which terms may matter.

    ``ids`` are the terms that may matter, in order, ``a`` and ``a1`` their rows and labelled rows; ``alone``
    marks those that tell the label by themselves.  ``given`` are the places of the terms among whose rows
    another term could reach ``floor``: ``least1`` labelled rows that hold both, or ``least`` rows in all,
    are the fewest with which it could.
    """

    n: float
    n1: float
    ids: np.ndarray
    a: np.ndarray
    a1: np.ndarray
    alone: np.ndarray
    given: np.ndarray
    floor: float
    least1: np.ndarray
    least: np.ndarray


def _fewest(ratio, most: np.ndarray, floor: float) -> np.ndarray:
    """The least whole number from 1 to ``most`` at which the rising ``ratio`` reaches the floor, ``most`` + 1 if none does."""
    low, high = np.ones(len(most)), most + 1
    while (low < high).any():
        middle = np.floor((low + high) / 2)
        reached = ratio(middle) >= floor - 1e-6
        low, high = np.where(reached, low, np.minimum(middle + 1, high)), np.where(reached, np.minimum(middle, high), high)
    return low


def screen(ids: np.ndarray, a: np.ndarray, a1: np.ndarray, n: float, n1: float, least: float) -> Screen:
    """``Screen`` of the terms seen in 4 rows at least.

    Alone, the likelihood ratio has to be at least ``least``; for pairs it has to be as much higher as there
    are more given terms.  It is at most twice the entropy of the labels of the given term's rows.  Where a
    term is more frequent among labelled rows it grows as the other rows with both are fewer, else as the
    labelled ones are, which bounds the rows that are needed.
    """
    seen = a >= 4
    ids, a, a1 = ids[seen], a[seen].astype(np.float64), a1[seen].astype(np.float64)
    share = np.clip(a1 / a, 1e-12, 1 - 1e-12)
    bound = -2 * (a1 * np.log(share) + (a - a1) * np.log(1 - share))
    floor = least + 2 * np.log(max(1, (bound >= least).sum()))
    given = np.flatnonzero(bound >= floor)
    t1, t = a1[given], a[given]
    least1 = _fewest(lambda k: _ratio(k, k, t1, t), t1, floor)
    fewest = _fewest(lambda c: _ratio(np.zeros(len(t)), c, t1, t), t - t1, floor)
    alone = _ratio(a1, a, n1, n) >= least
    matter = alone.copy()
    if len(given):
        matter |= (a1 >= least1.min()) | (a >= fewest.min())
        matter[given] = True
    place = np.cumsum(matter) - 1
    return Screen(n, n1, ids[matter], a[matter], a1[matter], alone[matter], place[given], floor, least1, fewest)


def told_by_pairs(seen: Screen, turns: np.ndarray, columns: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the terms in pairs of which one tells the label among the rows that hold the other, and not so elsewhere.

    ``turns`` are the numbers of the given terms to look at; ``columns`` and ``starts`` the rows' terms as
    places in ``seen``.  All other terms are counted for each of them.
    """
    size, chosen = len(seen.ids), np.zeros(len(seen.ids), dtype=bool)
    asked = np.full(size, -1, dtype=np.int32)
    asked[seen.given[turns]] = np.arange(len(turns))
    # in stretches: no array of the size of all terms is made here
    at = np.concatenate([i + np.flatnonzero(asked[columns[i : i + STRETCH]] >= 0) for i in range(0, max(len(columns), 1), STRETCH)])
    which = asked[columns[at]]
    holders = (np.searchsorted(starts, at, side="right") - 1)[np.argsort(which, kind="stable")]
    ends = np.cumsum(np.bincount(which, minlength=len(turns)))
    none = np.zeros(size, np.int64)
    for i, turn in enumerate(turns):
        t = seen.given[turn]
        a, a1 = seen.a[t], seen.a1[t]
        held = holders[ends[i] - int(a) : ends[i]]
        both = [np.bincount(np.concatenate([columns[starts[r] : starts[r + 1]] for r in own]), minlength=size) if len(own) else none
                for own in (held[y[held] == 0], held[y[held] == 1])]
        c = both[0] + both[1]
        near = np.flatnonzero(((both[1] >= seen.least1[turn]) | (c >= seen.least[turn])) & (c >= 4) & (c < a))
        told = near[_ratio(both[1][near], c[near], a1, a) >= seen.floor]
        # against the odds ratio among the rows without the given term, one if there are none
        n1, n0 = seen.n1 - a1, seen.n - seen.n1 - a + a1
        b1, b = seen.a1[told] - both[1][told], seen.a[told] - c[told]
        part = (n1 + 0.5) / (n1 + n0 + 1)
        odds = (b1 + part) * (n0 - b + b1 + 1 - part) / ((b - b1 + 1 - part) * (n1 - b1 + part))
        told = told[_ratio(both[1][told], c[told], a1, a, odds) >= seen.floor]
        if len(told):
            chosen[told] = chosen[t] = True
    return np.flatnonzero(chosen)


def telling_terms(sets: list[np.ndarray], y: np.ndarray, least: float) -> np.ndarray:
    """Term ids whose presence goes with the label, alone (``least``) or given another term (both of the pair)."""
    with1, with_any = np.zeros(SPACE), np.zeros(SPACE)
    for own, label in zip(sets, y, strict=True):
        with_any[own] += 1
        if label:
            with1[own] += 1
    seen = screen(np.arange(SPACE), with_any, with1, len(y), y.sum(), least)
    place = np.full(SPACE, -1, dtype=np.int32)
    place[seen.ids] = np.arange(len(seen.ids))
    rows = [own[own >= 0] for own in (place[x] for x in sets)]
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    paired = told_by_pairs(seen, np.arange(len(seen.given)), np.concatenate(rows), starts, y)
    return seen.ids[np.union1d(np.flatnonzero(seen.alone), paired)]


def fit_machine(sets: list[np.ndarray], y: np.ndarray, rank: int = 6, epochs: int = 20, rate: float = 0.03, least: float = LEAST) -> Machine:
    """Adam on the log loss over the telling terms (found here unless given); ``sets`` are the distinct term ids of each row.

    Without rows of both kinds only the bias is set.
    """
    column = np.full(SPACE, -1, dtype=np.int32)
    terms = telling_terms(sets, y, least) if len(set(y.tolist())) == 2 else np.zeros(0, np.int64)
    column[terms] = np.arange(len(terms))
    kept = [own[own >= 0] for own in (column[x] for x in sets)]
    starts = np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int64)
    return descend(column, np.concatenate(kept) if kept else np.zeros(0, np.int32), starts, y, rank, epochs, rate)


def descend(column: np.ndarray, cols: np.ndarray, begins: np.ndarray, y: np.ndarray, rank: int = 6, epochs: int = 20, rate: float = 0.03) -> Machine:
    """The fit on rows whose columns lie behind one another in ``cols``."""
    rng, size, step = np.random.default_rng(5), int(column.max()) + 1, 0
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    made = Machine(column, float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    if not size:
        return made
    lengths = np.diff(begins)
    # the rarer label weighs more, by the root of the ratio of the two
    weigh = np.where(y == 1, max(1.0, np.sqrt((len(y) - y.sum()) / y.sum())), max(1.0, np.sqrt(y.sum() / (len(y) - y.sum()))))
    first, second = np.zeros((size, rank + 1)), np.zeros((size, rank + 1))
    order = np.arange(len(y))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            part = np.concatenate([cols[begins[r] : begins[r + 1]] for r in rows])
            runs = np.concatenate([[0], np.cumsum(lengths[rows])])
            error = weigh[rows] * (sigmoid(made.logits(runs, part)) - y[rows]) / len(rows)
            each = np.repeat(error, lengths[rows])
            own = made.factor[part]
            slope = each[:, None] * (np.repeat(_sums(own, runs), lengths[rows], axis=0) - own)
            used, place = np.unique(part, return_inverse=True)
            g = np.empty((len(used), rank + 1))
            g[:, 0] = np.bincount(place, weights=each, minlength=len(used)) + 2e-5 * made.weight[used]
            for k in range(rank):
                g[:, k + 1] = np.bincount(place, weights=slope[:, k], minlength=len(used)) + 2e-4 * made.factor[used, k]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * g
            second[used] = 0.999 * second[used] + 0.001 * g * g
            move = rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
            made.weight[used] -= move[:, 0]
            made.factor[used] -= 0.2 * move[:, 1:]
            made.bias -= rate * float(error.sum())
    return made


def _known_sets(docs: DataFrame, sample: DataFrame, most_terms: int) -> DataFrame:
    """Stored (doc_id, y, ids): the term set of one text of each sampled id, of ``most_terms`` terms in all."""

    def sets_of(batches):
        terms = terms_of()
        for batch in batches:
            for part in slices(batch["text"]):
                rows = batch.iloc[part]
                starts, ids = term_sets(rows["text"].tolist(), terms)
                sets = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pd.DataFrame({"doc_id": rows["doc_id"], "y": rows["y"], "ids": sets})

    known = stage(sampled_texts(docs, sample).mapInPandas(sets_of, "doc_id long, y int, ids binary"), "toxicity-sets")
    total = known.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] / 4
    share = min(1.0, most_terms / max(total, 1.0))
    return known.where(F.pmod(F.xxhash64(F.lit("terms"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _counts(known: DataFrame) -> pd.DataFrame:
    """id, a, a1: rows and labelled rows of every term; at most SPACE lines."""

    def counted(batches):
        held = np.zeros((2, SPACE), dtype=np.int64)
        for batch in batches:
            for ids, y in zip(batch["ids"], batch["y"], strict=True):
                held[:, np.frombuffer(ids, dtype="<u4")] += [[1], [y]]
        ids = np.flatnonzero(held[0])
        for at in range(0, len(ids), 100_000):
            own = ids[at : at + 100_000]
            yield pd.DataFrame({"id": own, "a": held[0, own], "a1": held[1, own]})

    made = known.select("y", "ids").mapInPandas(counted, "id long, a long, a1 long")
    return made.groupBy("id").agg(F.sum("a").alias("a"), F.sum("a1").alias("a1")).where("a >= 4").toPandas().sort_values("id")


def learned_machine(docs: DataFrame, labels: DataFrame, keep, most_labels: int, most_terms: int, least: float = LEAST) -> Machine:
    """The machine fitted on a bounded sample of labelled rows; terms and pairs of terms are counted by tasks."""
    spark = docs.sparkSession
    known = _known_sets(docs, sampled_labels(labels, "toxic", keep, most_labels), most_terms)
    n, n1 = (float(x) for x in known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first())
    if not 0 < n1 < n:
        return fit_machine([], np.r_[np.ones(int(n1)), np.zeros(int(n - n1))])
    counts = _counts(known)
    seen = screen(*(counts[c].to_numpy() for c in ("id", "a", "a1")), n, n1, least)
    kind = "<u2" if len(seen.ids) <= 1 << 16 else "<u4"

    def placed(batches):
        for batch in batches:
            made = []
            for ids in batch["ids"]:
                own = np.frombuffer(ids, dtype="<u4")
                at = np.searchsorted(seen.ids, own)
                at[at == len(seen.ids)] = 0
                made.append(at[seen.ids[at] == own].astype(kind).tobytes() if len(seen.ids) else b"")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "places": made})

    # bounded by most_labels rows and most_terms terms
    rows = known.mapInPandas(placed, "doc_id long, y int, places binary").toPandas().sort_values("doc_id", kind="stable")
    columns, y = np.frombuffer(b"".join(rows["places"]), dtype=kind), rows["y"].to_numpy(dtype=np.float64)
    starts = np.r_[0, np.cumsum([len(p) // columns.itemsize for p in rows["places"]])]
    del rows, counts

    held = spark.sparkContext.broadcast((seen, columns, starts, y))

    def told(batches):
        for batch in batches:
            for turn in batch["id"]:
                every = held.value
                found = told_by_pairs(every[0], np.arange(turn, len(every[0].given), TURNS), *every[1:])
                if len(found):
                    yield pd.DataFrame({"place": found})

    pairs = spark.range(0, TURNS, 1, TURNS).mapInPandas(told, "place long").distinct().toPandas()["place"].to_numpy(dtype=np.int64)
    held.destroy()
    chosen = np.union1d(np.flatnonzero(seen.alone), pairs)
    place, column = np.full(len(seen.ids), -1, dtype=np.int32), np.full(SPACE, -1, dtype=np.int32)
    place[chosen] = column[seen.ids[chosen]] = np.arange(len(chosen))
    cols = place[columns]
    kept = np.r_[0, np.cumsum(cols >= 0)]
    return descend(column, cols[cols >= 0], kept[starts], y)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, parts: int = 3, held: int = 1,
                    most_labels: int = 12_000, most_terms: int = 12_000_000) -> DataFrame:
    """Every column of ``docs`` and held_out boolean, score double, predicted int (1: toxic).

    Rows of fold ``held`` (crc32 of the id modulo ``parts``) are never learned from.  ``most_labels`` bounds
    the labelled ids and ``most_terms`` the distinct terms of their texts that the machine is fitted on; of
    an id that repeats one text is learned from, the one of the least hash.  Whole texts are read, a
    stretch at a time; a null or empty text has no terms and gets the bias alone.  Repeated rows are scored
    each, equal texts alike; columns of ``docs`` with one of the three result names are replaced; without
    usable labels every score is 0.5; an empty table gives an empty table.
    """
    machine = learned_machine(docs, labels, fold("doc_id", parts) != held, most_labels, most_terms)
    ids = np.flatnonzero(machine.column >= 0)
    ids = ids[np.argsort(machine.column[ids])].astype(np.int32)
    rest = (machine.bias, machine.weight, machine.factor)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, column = terms_of(), np.full(SPACE, -1, dtype=np.int32)
        column[ids] = np.arange(len(ids))
        own = Machine(column, *rest)
        for batch in batches:
            made = [own.score(batch.iloc[part].tolist(), terms) for part in slices(batch)]
            yield pd.Series(np.concatenate(made) if made else np.zeros(0))

    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return (
        docs.select(*columns)
        .withColumn("held_out", fold("doc_id", parts) == held)
        .withColumn("score", score(F.col("text")))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
