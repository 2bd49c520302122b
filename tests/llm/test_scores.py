"""Quality classifier and toxicity machine: held-out accuracy on the given tables, odd inputs, parts against plain code."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import common, quality, toxicity

SMALL = "/root/testdata/sf0.01"


def test_terms_against_plain_code():
    texts = ["Ab, cd!! é\n_x9", "", None, " ", "日本 a-b", "x" * 30 + " " + "é" * 5]
    terms = common.Terms(1 << 40, lower=True)
    place, ids = terms(texts)
    for i, text in enumerate(texts):
        # runs of letters (any character beyond ASCII counts as one), or runs of other marks
        words = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+|[^0-9a-z_\u0080-\U0010ffff\x20\x09-\x0d]+", (text or "").lower())
        assert (place == i).sum() == len(words)
        for word, own in zip(words, ids[place == i], strict=True):
            assert terms([word])[1].tolist() == [own]
    assert len(set(ids.tolist())) == len(set(re.findall(r"\S+", "ab , cd !! é _x9 日本 a - b xxx ééééé")))


def test_long_text_in_runs_gives_the_same_terms(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(500))
    whole = [x[3].tolist() for x in common.Terms(1 << 20).runs([text])]
    monkeypatch.setattr(common, "RUN", 100)
    cut = [i for x in common.Terms(1 << 20).runs(["a", text, None, text]) for i in x[3].tolist()]
    assert cut[1 : 1 + len(whole[0])] == whole[0] and len(cut) == 1 + 2 * len(whole[0])


def test_context_sums_against_plain_code(docs_of):
    rows = [(1, "a b a c"), (2, "b"), (3, None), (4, ""), (5, "c c a")]
    got = {r["bucket"]: [r[f"c{i}"] for i in range(quality.DIMS)] for r in quality.context_sums(docs_of(rows)).collect()}
    places, signs = quality.index_vectors()
    want: dict[int, np.ndarray] = {}
    for _, text in rows:
        ids = common.Terms(quality.BUCKETS)([text])[1].tolist()
        for i, own in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if j != i:
                    sums = want.setdefault(own, np.zeros(quality.DIMS, dtype=int))
                    for p, s in zip(places[ids[j]], signs[ids[j]], strict=True):
                        sums[p] += int(s)
    assert got == {k: v.tolist() for k, v in want.items() if v.any()}


def test_pooled_against_plain_code():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.BUCKETS + 1, quality.DIMS)).astype(np.float32)
    terms, text = common.Terms(quality.BUCKETS), "one two, two three"
    own = vectors[terms([text])[1]].astype(float)
    got = quality.pooled([text, None, ""], vectors, terms)
    assert np.allclose(got[0], np.r_[own.mean(axis=0), own.std(axis=0), (own[1:] * own[:-1]).mean(axis=0)], atol=1e-4)
    assert not got[1:].any()


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.fit_network(x[:1500], y[:1500])
    assert ((net.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9 and 0.25 <= net.temperature <= 8
    assert np.allclose(quality.fit_network(x[:0], y[:0]).score(x[:2]), 0.5)


def test_machine_learns_a_pair_that_no_weight_shows():
    rng = np.random.default_rng(0)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    y = (a == b).astype(float)
    sets = [np.array(sorted([1] * int(p) + [2] * int(q) + [3])) for p, q in zip(a, b, strict=True)]
    sets = [np.unique(s) for s in sets]
    starts = np.r_[0, np.cumsum([len(s) for s in sets])]
    machine = toxicity.fit_machine(sets, y, epochs=60, least=0.0, rate=0.05)
    assert ((machine.logits(starts, machine.column[np.concatenate(sets)]) > 0) == y).mean() > 0.95


def test_machine_learns_pairs_at_the_default():
    rng = np.random.default_rng(0)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    sets = [np.array([1] * int(p) + [2] * int(q) + [3]) for p, q in zip(a, b, strict=True)]
    machine, y = toxicity.fit_machine(sets, (a == b).astype(float), epochs=60, rate=0.05), a == b
    starts = np.r_[0, np.cumsum([(machine.column[s] >= 0).sum() for s in sets])]
    columns = np.concatenate([machine.column[s] for s in sets])
    assert ((machine.logits(starts, columns[columns >= 0]) > 0) == y).mean() > 0.95
    # an insult and a group word: toxic together, among noise and rows that are toxic by a word of their own
    n = 16_000
    group, insult, other = rng.random(n) < 0.2, rng.random(n) < 0.05, rng.random(n) < 0.02
    both = np.flatnonzero(group & insult)
    group[both[32:]] = False
    y = other.astype(float)
    y[both[:32]] = 1
    noise = rng.integers(10, 3000, (n, 30))
    sets = [np.unique([*f, *([1] if p else []), *([2] if q else []), *([5] if t else [])]) for f, p, q, t in zip(noise, group, insult, other, strict=True)]
    machine = toxicity.fit_machine(sets, y)
    assert {1, 2, 5} <= set(np.flatnonzero(machine.column >= 0)) and len(machine.weight) < 30
    logit = lambda *terms: machine.logits(np.array([0, len(terms)]), machine.column[list(terms)])[0]
    assert logit(1) < 0 and logit(2) < 0 and logit(1, 2) > 0 and logit(5) > 0


def test_machine_logits_against_plain_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    terms = [2, 5, 7]
    want = 0.3 + machine.weight[terms].sum() + sum(machine.factor[i] @ machine.factor[j] for i in terms for j in terms if i < j)
    got = machine.logits(np.array([0, 3, 3]), np.array(terms))
    assert np.allclose(got, [want, 0.3])


@pytest.mark.parametrize(("score", "label", "parts", "held", "least"), [
    (quality.quality_scores, "quality", 5, 0, 0.95), (toxicity.toxicity_scores, "toxic", 3, 1, 0.9),
])
def test_held_out_accuracy(spark, score, label, parts, held, least):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    out = score(docs, labels).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    fold = out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % parts)
    assert (out["held_out"] == (fold == held)).all()
    both = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (both["predicted"] == both[label]).mean() >= least


@pytest.mark.parametrize(("score", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_odd_rows(spark, docs_of, score, label):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 1), (2, 1, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = [(1, "good text"), (2, "x"), (None, "same"), (None, "same"), (4, None), (5, ""), (6, "w " * 30_000)]
    clash = docs_of(rows).withColumn("score", F.lit("old")).withColumn("held_out", F.lit(3))
    out = score(clash, labels).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and isinstance(r["held_out"], bool) for r in out)
    by = {r["text"]: r["score"] for r in out}
    assert by[None] == by[""]
    assert [r["score"] for r in score(docs_of(rows), labels.limit(0)).collect()] == pytest.approx([0.5] * 7)
    assert score(docs_of(rows).limit(0), labels).collect() == []
