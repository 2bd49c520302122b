"""Near duplicates against brute force, in one block and in many."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablemill.llm import graph, jaccard


def grams(text, n=5):
    words = (text or "").split(" ")
    words = [w for w in words if w]
    if len(words) >= n:
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def plain(rows, similarity=0.8):
    by = defaultdict(list)
    for i, text in rows:
        by[text or ""].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    texts = list(by)
    root, links = {t: t for t in texts}, Counter()

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    sets = {t: grams(t) for t in texts}
    for k, a in enumerate(texts):
        for b in texts[:k]:
            both = len(sets[a] & sets[b])
            if both and 1000 * both >= round(1000 * similarity) * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for t in texts:
        groups[find(t)] += by[t]
    return sorted(((i, least(groups[find(t or "")]), least(by[t or ""]), links[t or ""]) for i, t in rows), key=repr)


def rows_of():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30))
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "one  two"), (6, "one two three"), (4, "one two"), (None, "null id here"), (None, None)]
    for base in range(12):
        text = [word() for _ in range(rng.randint(40, 140))]
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 100, " ".join(copy)))
            if rng.random() < 0.3:
                rows.append((len(rows) + 100, rows[-1][1]))
    return rows


def test_against_brute_force(docs_of, monkeypatch):
    rows = rows_of()
    docs = docs_of(rows).withColumns({"k1": F.lit("x"), "cid": F.lit(0), "bands": F.lit("y")})
    want = plain(rows)
    assert sum(r[3] for r in want) > 50
    assert sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=repr) == want
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    assert sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=repr) == want


def test_long_chains_are_verified_by_buckets(docs_of, monkeypatch):
    """Windows that move along one text: each is near a few others, and all hang together."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(900)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(280)] + [(1000 + i, " ".join(words[3 * i : 3 * i + 60])) for i in range(0, 280, 9)]
    # and a dense group, which is verified whole
    rows += [(2000 + i, " ".join([*words[:30], f"end{i}"])) for i in range(40)]
    want = plain(rows)
    assert sum(r[3] for r in want) > 700
    chosen, cells = [], jaccard._cells

    def seen(members):
        made = cells(members)
        chosen.extend(r.no for r in made.select(F.explode("cells.no").alias("no")).collect())
        return made

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "_cells", seen)
    assert sorted((tuple(r) for r in jaccard.near_duplicates(docs_of(rows)).collect()), key=repr) == want
    assert chosen.count(-1) >= 40 and sum(no > 0 for no in chosen) > 280


def test_one_stays_of_each_group(docs_of):
    rows = rows_of()
    docs = docs_of(rows).withColumn("__k1", F.lit(5))
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_per_group(docs.drop("__k1")).collect()]
    first = {}
    for (i, cls, copy, _), (_, t) in zip(plain(rows), sorted(rows, key=lambda r: repr((r[0],))), strict=False):
        first.setdefault(cls, copy)
    groups = {r[1] for r in plain(rows)}
    assert len(kept) == len(groups) and {i for i, _ in kept} == groups


def test_empty_table(docs_of):
    assert jaccard.near_duplicates(docs_of([(1, "a")]).limit(0)).collect() == []
    assert jaccard.one_per_group(docs_of([(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize(("similarity", "recall"), [(0.8, 0.9999), (0.8, 0.99), (0.9, 0.999), (0.5, 0.95)])
def test_banding_reaches_its_recall(similarity, recall):
    bands, rows = jaccard.banding(similarity, recall)
    assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= 192


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    assert set(got) == set(root)
    pairs = {(got[n], find(n)) for n in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_a_row_that_repeats_in_a_third_of_the_table(docs_of):
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join(words[:-1] + ["x"]), " ".join(f"z{i}" for i in range(40))
    rows = [(1, " ".join(words))] * 300 + [(2, near)] + [(10 + i, f"{far} {i} " * 3) for i in range(600)]
    got = jaccard.near_duplicates(docs_of(rows)).where("doc_id < 3").distinct().collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(1, 1, 1), (2, 1, 1)]
    kept = jaccard.one_per_group(docs_of(rows)).where("doc_id < 3").collect()
    assert [r["doc_id"] for r in kept] == [1]
