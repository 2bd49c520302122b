"""Mixing against plain code, its SQL and hand-made cases."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tablemill.llm import mixing

ROWS = (
    [(i, "a b c " * (i % 7), f"s{i % 4}") for i in range(400)]
    + [(500, None, "s1"), (501, "", None), (502, " \t\n ", "zz"), (503, "x\x0by z w", None), (504, "tiny", "m"), (505, "one two", "퟿"), (506, "three", "\U0001F600")]
    + [(504, "tiny", "m"), (None, "no id", "m"), (507, "w " * 20_000, "s0")]
)


def plain(rows, weights, limit, seed):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, sum(size)
    open_ = set(names)
    while open_:
        level = free / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= limit * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = limit * total[s]
            free -= target[s]
        open_ -= full
    out = []
    for (doc_id, text, source), n in zip(rows, size):
        rate = min(limit, target[source] / total[source]) if total[source] else 0
        key = f"{seed}:{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
        draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        out.append((doc_id, n, total[source], target[source], n * (int(rate) + (draw < rate - int(rate)))))
    return sorted(out, key=repr)


def taken(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")).collect()), key=repr)


@pytest.mark.parametrize("weights,limit,seed", [((5, 2, 1), 3.0, 17), ((1,), 1.5, 3), ((100, 1), 2.0, 4)])
def test_against_plain_code_and_sql(docs_of, weights, limit, seed):
    got = taken(mixing.mix_documents(docs_of(ROWS), weights, limit, seed))
    want = plain(ROWS, weights, limit, seed)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", ROWS)
    assert sorted(con.execute(mixing.mixing_sql(weights, limit, seed)).fetchall(), key=repr) == got
    assert sum({(r[2], r[3]): r[3] for r in got}.values()) == pytest.approx(sum(r[1] for r in got))


def test_many_sources_without_broadcast(docs_of, monkeypatch):
    """One source is hot, all others meet their targets by the join."""
    monkeypatch.setattr(mixing, "SHARE", 0.2)
    monkeypatch.setattr(mixing, "BROADCAST", 10)
    rows = [(i, "w " * (i % 5), f"h{i % 90}" if i % 3 else "hot") for i in range(900)] + [(900, "a b", None)]
    got = taken(mixing.mix_documents(docs_of(rows)))
    want = plain(rows, (5, 2, 1), 3.0, 17)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]


def test_taken_words_come_near_the_target(docs_of):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(9000)]
    mixed = mixing.mix_documents(docs_of(rows))
    for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 0.05 * r.g
    assert taken(mixed.repartition(3)) == taken(mixing.mix_documents(docs_of(rows[::-1])))


def test_emitted_copies_and_clashing_columns(docs_of):
    docs = docs_of(ROWS).withColumns({"target": F.lit("old"), "pos": F.lit(1), "weight": F.lit(2), "level": F.lit("x"), "a.b": F.lit(3)})
    mixed = mixing.mix_documents(docs)
    assert set(mixed.columns) == set(docs.columns) | {"size", "source_size", "copies"}
    copies = mixing.emit_copies(mixed)
    assert copies.count() == mixed.agg(F.sum("copies")).first()[0]
    assert copies.agg(F.max("copy")).first()[0] <= 3


def test_empty_table_and_no_words(docs_of):
    assert mixing.mix_documents(docs_of(ROWS).limit(0)).collect() == []
    assert taken(mixing.mix_documents(docs_of([(1, None, "a"), (2, " ", None)]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
