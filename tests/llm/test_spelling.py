"""Spelling groups against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablemill.llm import spelling


def brute_counts(rows, every=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(b) > len(a) else a[i + 1 :] == b[i + 1 :]


def brute(rows, every=97):
    n = brute_counts(rows, every)
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, own in beside.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def typos(seed, letters, n_docs=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 12))) for _ in range(30)]
    def variant(w):
        if rng.random() < 0.6:
            return w
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind < 2) :]
    return [(i, " ".join(variant(rng.choice(base)) for _ in range(rng.randint(0, 60)))) for i in range(n_docs)]


@pytest.mark.parametrize("letters", ["ab", "abcdéÀ÷", "aZßq"])
def test_against_brute_force(docs_of, letters):
    rows = typos(len(letters), letters)
    assert rows_of(spelling.spelling_groups(docs_of(rows), every=7)) == brute(rows, every=7)


def test_hot_chunks_are_refined_to_the_same_pairs(spark):
    rng = random.Random(3)
    words = sorted({"communicat" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(300)} | {"aaaaa", "aaaaaa", "aaaaaaa", "baaaa"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) for a in words for b in words if (len(a), a) < (len(b), b) and near(a, b))
    for many in (spelling.MANY, 50, 0):
        assert rows_of(spelling.near_pairs(df, many)) == want


def test_chains_are_followed(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("x", "y")], "word string, form string")
    assert dict(rows_of(spelling.follow(forms))) == {f"w{i:03}": "w040" for i in range(40)} | {"x": "y"}


def test_odd_rows(docs_of, monkeypatch):
    rows = [(1, "Hello hello HELLO hellö hellö helló"), (2, None), (3, ""), (None, "hellos hellos hellos x9hellos"), (3, "ÀÈÌÒÙ àèìòù ÀÈÌÒÙ ÀÈÌÒÙ-"), (3, "ÀÈÌÒÙ"),
            (4, "longword" * 3000 + " " + "longword" * 3000 + " z" + "longword" * 3000), (5, "longword" * 3000), (6, "퟿hello× hello× hello×")]
    docs = docs_of(rows).withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(2)})
    want = brute(rows)
    assert rows_of(spelling.spelling_groups(docs)) == want
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "Hello brave new wörld " * 3
    assert re.findall("[a-zÀ-ÿ]+", b" ".join(spelling.stretches(text)).decode()) == re.findall("[a-zÀ-ÿ]+", text.lower())
    assert rows_of(spelling.spelling_groups(docs.limit(0))) == []
