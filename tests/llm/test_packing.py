"""Packing: ids against the tokenizer itself, places without gaps, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "  x  y ", "a\n b\t c", "it's we'll 12 3.5 é ñ", "日本 語", "x<|endoftext|>y <|endoftext|>", "a\x1fb\xa0c", "q" * 3000, "word " * 2100]


def test_pieces_against_the_tokenizer(docs_of):
    rows = [*enumerate(ODD), (3, "a"), (None, "null id")]
    out = packing.packed_documents(docs_of(rows).withColumns({"piece": F.lit("x"), "length": F.lit(1)}), PATH, 64, keep_ids=True)
    got, table = out.collect(), Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in rows:
        ids = [*table.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()), ids[a:b]))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got), key=repr) == sorted(want, key=repr)
    check_places(got, 64)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(out).collect()}
    assert sum(map(len, whole.values())) == sum(w[3] for w in want) and max(map(len, whole.values())) <= 64


@pytest.mark.parametrize("text", [
    " " * 2_000_000, "a" + " " * 2_000_000 + "b", "it's\n" + "\n" * 2_000_000 + "'s", " \n\t\xa0\u3000" * 300_000 + "<|endoftext|>" + "\r" * 1_500_000 + "!",
    " " * 150_000 + "\x1f" + "\x85" * 150_000 + " x y  " + "\u2003" * 120_000 + "1" + " " * 99_999 + "z<|endoftext|> ",
])
def test_long_white_space_against_the_tokenizer(text):
    assert packing.ByteIds(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_short_runs_are_cut_out_alike(monkeypatch):
    coder, rng = packing.ByteIds(PATH), random.Random(4)
    texts = ["".join(rng.choice([" ", " ", "\n", "\t", "\xa0", "\x1c", "\u2028", "a", "é", "1", "!", "'s", "<|endoftext|>"]) for _ in range(40)) for _ in range(3000)]
    want = [coder(t).tolist() for t in texts]
    monkeypatch.setattr(packing, "LONG_RUN", 2)
    assert [coder(t).tolist() for t in texts] == want


def test_a_very_long_blank_document_is_packed(docs_of):
    text = "a" + " " * 2_000_000 + "b"
    got = packing.packed_documents(docs_of([(1, text), (2, "c")]), PATH).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids) + 1
    check_places(got, 1024)


def check_places(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= capacity for v in at.values())


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for _ in range(rng.choice([3, 400, 20_000])):
        counts[min(capacity, max(1, int(rng.choice([rng.uniform(1, capacity), rng.gauss(capacity / 3, capacity / 20)]))))] += 1
    plan = packing.plan_packing(counts, capacity)
    fill: dict[int, list] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs = sorted(plan.runs)
    for k, (length, first, per, sequence, offset) in enumerate(runs):
        stop = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
        assert first == used[length]
        for r in range(first, stop):
            fill.setdefault(sequence + (r - first) // per, []).append((offset + (r - first) % per * length, length))
        used[length] = stop
    assert (used == counts).all() and len(fill) == plan.sequences
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    plain = packing.Plan(counts, capacity)
    for s in range(capacity, 0, -1):
        plain.best_fit(s)
    assert plan.sequences <= max(plain.sequences * 1.01 + 3, least * 1.01 + 3)


def test_best_pattern_against_all_fills():
    sizes, worth, capacity = np.array([7, 3, 5]), np.array([0.7, 0.28, 0.51]), 17
    best = max((a * 0.7 + b * 0.28 + c * 0.51, a, b, c) for a in range(3) for b in range(6) for c in range(4) if 7 * a + 3 * b + 5 * c <= capacity)
    value, pattern = packing.best_pattern(sizes, worth, capacity)
    assert value == pytest.approx(best[0]) and sizes @ pattern <= capacity and worth @ pattern == pytest.approx(value)


def test_empty_table(docs_of):
    assert packing.packed_documents(docs_of([(1, "a")]).limit(0), PATH).collect() == []
