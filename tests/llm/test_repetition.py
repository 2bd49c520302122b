"""Suffix-array measures against brute force."""

import random
import re

from pyspark.sql import functions as F

from tablemill.llm import repetition


def plain(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    spans, windows, seen, doubles = set(), set(), set(), 0
    for i, k in enumerate(longest):
        spans.update(range(i, i + k) if k >= least else ())
        windows.update(range(i, i + 8) if k >= 8 else ())
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    failed = n < 20 or 100 * len(windows) > 30 * n
    kept = not failed and len(spans) <= 0.3 * n and max(longest, default=0) <= 0.2 * n
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), doubles, len(windows), failed, kept, len(spans), max(longest, default=0))


def texts():
    rng = random.Random(4)
    fixed = [None, "", "  \n ", "a", "é # é", "x\n\nx\nx ", "a\x1fb\x1f c", "a " * 60, " ".join(map(str, range(60))), "a b c　d"]
    odd = [" ".join(rng.choice("abé|") for _ in range(rng.randint(1, 70))) + rng.choice(["", "\n", "\n#a*\n"]) for _ in range(120)]
    long = [" ".join(str(rng.randint(0, 400)) for _ in range(120)) for _ in range(20)]
    part = [w + " " + " ".join(w.split()[20:60]) for w in long]
    return fixed + odd + long + part


def test_against_brute_force(docs_of, monkeypatch):
    rows = list(enumerate(texts()))
    rows += [(5, rows[-1][1]), (None, "q w")]
    got = repetition.repetition_rules(docs_of(rows).withColumn("n_words", F.lit("x"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *plain(t, 5)) for i, t in rows), key=repr)


def test_small_runs_give_the_same(monkeypatch):
    all_texts = [t or "" for t in texts()]
    powers = repetition.Powers()
    whole = repetition._measures(all_texts, 5, powers).values.tolist()
    assert whole == [repetition._measures([t], 5, powers).values.tolist()[0] for t in all_texts]


def test_empty_table(docs_of):
    assert repetition.repetition_rules(docs_of([(1, "a")]).limit(0)).collect() == []
