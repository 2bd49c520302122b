"""SentencePiece: chunks against the whole, the lattice against all paths and the library, round trips."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tablemill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  blanks ", "the the", "日本 語 \U0001f600", "tab\tline\nend", "a▁b", "=" * 500, "x" * 1300 + " y", "word " * 400]


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(PATH)


def test_against_all_paths(lattice):
    rng = random.Random(0)
    for _ in range(150):
        text = "▁" + "".join(rng.choice("theans") for _ in range(rng.randint(1, 8)))
        paths = [split(text, cuts) for cuts in itertools.product([0, 1], repeat=len(text) - 1)]
        best = max(sum(lattice.score[p][0] for p in path) for path in paths if all(p in lattice.score for p in path))
        ids = lattice.encode(text)
        assert lattice.decode(ids) == text and sum(lattice.score[lattice.piece[i]][0] for i in ids) == best


def split(text, cuts):
    out = [text[0]]
    for char, cut in zip(text[1:], cuts, strict=True):
        if cut:
            out.append(char)
        else:
            out[-1] += char
    return out


def test_against_the_library(lattice):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1  # the same pieces, read as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for word in "the quick theaatble ciónmente Eaueuxa ungie configuration idiot 12345 a-b".split():
        best = max(sum(library.get_score(i) for i in ids) for ids in library.nbest_encode(word, nbest_size=10))
        assert sum(library.get_score(i) for i in lattice.encode("▁" + word)) == best


@pytest.mark.parametrize("cuttable", [True, False])
def test_chunks_against_the_whole(lattice, cuttable):
    rng = random.Random(1)
    for turn in range(60):
        text = "▁" + "".join(rng.choice(("abcthe", "a▁▁日é=*", "a", "the▁and▁of")[turn % 4]) for _ in range(rng.randint(1, 160)))
        want = lattice.back(text, len(text), *lattice.forward(text, len(text), [0.0])[1:])[1]
        size, m = rng.choice([16, 17, 33, 64]), lattice.longest
        parts = [(text[i : i + size + m - 1], min(size, len(text) - i)) for i in range(0, len(text), size)]
        lattice.cuttable = cuttable
        first = np.full(m, pieces.NEVER)
        first[0] = 0.0
        begins = [first, *pieces.prefix_products(np.array([lattice.matrix(*p) for p in parts]))[:-1, 0, :]]
        came = [lattice.sources(*p, list(f)) for p, f in zip(parts, begins, strict=True)]
        reach, reaches = 0, []
        for source in reversed(came):
            reaches.append(reach)
            reach = source[reach]
        got = [i for p, f, r in zip(parts, begins, reaches[::-1], strict=True) for i in lattice.chunk_ids(*p, list(f), r)[1]]
        lattice.cuttable = True
        assert got == want


def test_documents_and_round_trip(docs_of, lattice):
    rows = [*enumerate(ODD), (4, "the the"), (None, "null id")]
    docs = docs_of(rows).withColumns({"s": F.lit(1), "row": F.lit(2), "ids": F.lit("x")})
    whole = pieces.encode_documents(docs, PATH)
    got = sorted((tuple(r) for r in whole.collect()), key=repr)
    want = []
    for i, text in rows:
        shown = "▁" + text.replace(" ", "▁") if text else ""
        want.append((i, lattice.encode(shown), "▁" not in (text or "")))
    assert got == sorted(want, key=repr)
    assert sorted((tuple(r) for r in pieces.encode_documents(docs, PATH, chunk=40).collect()), key=repr) == got
    back = sorted(((r["doc_id"], r["text"]) for r in pieces.decode_documents(whole, PATH).collect()), key=repr)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=repr)


def test_empty_tables(docs_of, spark):
    assert pieces.encode_documents(docs_of([(1, "a")]).limit(0), PATH).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode_documents(none, PATH).first()["text"] is None


def test_stretches_solved_together_against_one_by_one(monkeypatch):
    lattice = pieces.Lattice(PATH)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij theo▁éÀ日=*0\U0001f600") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    texts = ["", *words, " ".join(words), "▁".join(words[:50]), "▁the" * 300]
    want = [lattice.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CELLS", 300)
    for keep in (pieces.KEEP, 0):
        monkeypatch.setattr(pieces, "KEEP", keep)
        lattice._forget()
        for _ in range(2):
            assert [i.tolist() for i in lattice.encoded_together(texts)] == want
    # pieces that share a slot, or are taken for others by their hash, change no ids
    monkeypatch.setattr(pieces, "SLOTS", 6)
    lattice._table()
    lattice._forget()
    assert [i.tolist() for i in lattice.encoded_together(texts)] == want
    lattice.hash[:] = 0
    monkeypatch.setattr(lattice, "_add", lambda h, c: np.zeros(c.shape, dtype=np.uint64))
    lattice.first[:], lattice.next[:] = -1, -1
    lattice.first[0] = lattice.id.argmax()
    lattice._forget()
    sure = lattice._solve(np.array([[ord("t"), ord("h")]], dtype="<u4"))[2]
    assert not sure.any()


def test_all_given_documents_decode(spark, lattice):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = pieces.encode_documents(docs, PATH, chunk=20_000).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in whole:
        shown = "▁" + r["text"].replace(" ", "▁") if r["text"] else ""
        assert r["exact"] == ("▁" not in (r["text"] or "")) and r["ids"] == lattice.encode(shown)
