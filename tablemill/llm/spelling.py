"""Spelling variant grouping: words at one edit from a much more frequent word belong to it.

Near words are found by asymmetric chunks.  One word of a pair is cut into two disjoint chunks; an edit
touches at most one of them, so the other stands unchanged in the second word, shifted by no more than
one place.  Of the second word all grams at the places where such a chunk can lie are listed, and the two
meet on equal text.  What is left of both beside the chunk differs by the one edit again, so a chunk that
too many words share is refined by cutting what is left in the same way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage

#: Bytes of UTF-8 text of a run of A-Z (lower-cased), a-z and U+00C0 to U+00FF.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Words that a task counts before it hands them on, and characters of a text that it looks at at once.
KEEP = 200_000
STRETCH = 1_000_000
#: Pairs that one chunk may propose before it is refined.
MANY = 20_000


def stretches(text: str):
    """The text in parts of bounded length, lower-cased in A-Z as UTF-8, never cut inside a run."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        while end < len(text) and (text[end].isascii() and text[end].isalpha() or "À" <= text[end] <= "ÿ"):
            end += 1
        yield text[at:end].encode("utf-8", "surrogatepass").lower()
        at = end


def altered(run: bytes, h: int) -> str:
    """The run without its code point number h modulo its length."""
    word = run.decode()
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of all words of at least ``least_length`` code points found ``least`` times or more.

    In runs whose crc32 together with the id is a multiple of ``every`` one code point is deleted.  A
    task counts in bounded memory and hands on one row per word and fill.
    """

    def counted(batches):
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                before = zlib.crc32(f"{doc_id}:".encode())
                own: Counter = Counter()
                for part in stretches(text):
                    own.update(RUNS.findall(part))
                for run, n in own.items():
                    h = zlib.crc32(run, before)
                    if h % every:
                        found[run] += n
                    else:
                        found[altered(run, h).encode()] += n
                if len(found) > KEEP:
                    yield pd.DataFrame({"word": [w.decode() for w in found], "n": list(found.values())})
                    found.clear()
        if found:
            yield pd.DataFrame({"word": [w.decode() for w in found], "n": list(found.values())})

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.mapInPandas(counted, "word string, n long").where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cut(rows: DataFrame) -> DataFrame:
    """Two rows of each: the first half of what is left has met, or the second half has.

    ``rest`` is what is left of a word and ``own`` what is left of the shorter word of the pair, which
    says where both are cut; ``key`` is the hash of all that has met.
    """
    half = F.floor(F.col("own") / 2).cast("int")
    n = F.length("rest")
    first = F.struct(
        F.xxhash64("key", F.lit("<"), F.substring("rest", F.lit(1), half)).alias("key"),
        F.substring("rest", half + 1, n - half).alias("rest"),
        (F.col("own") - half).alias("own"),
    )
    second = F.struct(
        F.xxhash64("key", F.lit(">"), F.substring("rest", n - (F.col("own") - half) + 1, F.col("own") - half)).alias("key"),
        F.substring("rest", F.lit(1), n - (F.col("own") - half)).alias("rest"),
        half.alias("own"),
    )
    whole = [c for c in rows.columns if c not in ("key", "rest", "own")]
    return rows.select(*whole, F.explode(F.array(first, second)).alias("cut")).select(*whole, "cut.*")


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, many: int = MANY) -> DataFrame:
    """(a, b): every pair of ``word`` that differ by exactly one edit, once, the shorter (or smaller) first.

    Chunks that would propose more than ``many`` pairs are cut further until one code point of the
    shorter word is left, when only pairs that differ there can still meet.
    """
    size = F.length("word")
    chunks = words.select("word", F.col("word").alias("rest"), size.alias("own"), F.xxhash64(size).alias("key"))
    # the other word is as long or longer by one; its grams are taken where the shorter word's chunks can lie
    longer = F.explode(F.array(size, size - 1)).alias("own")
    grams = words.select("word", F.col("word").alias("rest"), longer).withColumn("key", F.xxhash64("own"))
    pairs, left = None, 1
    while left:
        chunks, grams = stage(_cut(chunks), "spelling-chunks"), stage(_cut(grams), "spelling-grams")
        both = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).join(
            grams.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key"
        )
        # stored, so that Spark knows how few they are
        hot = stage(both.where((F.col("n") * F.col("m") > many) & (F.col("own") > 1)).select("key"), "spelling-hot")
        left = hot.count()
        few, fewer = (chunks, grams) if not left else (chunks.join(hot, "key", "left_anti"), grams.join(hot, "key", "left_anti"))
        a, b = few.select("key", F.col("word").alias("a")), fewer.select("key", F.col("word").alias("b"))
        unlike = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
        found = a.join(b, "key").where(unlike & _one_edit(F.col("a"), F.col("b"))).select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        if left:
            chunks, grams = chunks.join(hot, "key", "left_semi"), grams.join(hot, "key", "left_semi")
    return pairs.distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in as many rounds as the logarithm of the longest way."""
    paths = stage(forms.select("word", F.col("form").alias("root")), "spelling-paths")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(paths.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-paths")
        paths = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return paths


def spelling_groups(docs: DataFrame, least_length: int = 5, least: int = 3, every: int = 97, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (see ``word_counts``).

    A word's form is its near word of the largest n, of equal ones the smallest in code-point order, if
    that n is ``factor`` times its own at least; its root is the last of the forms that follow.  Null
    texts have no words; a null id counts as empty text; repeated rows count each time; very long texts
    are read in stretches and very long words are words; other columns are not looked at; an empty table
    gives an empty table.
    """
    words = stage(word_counts(docs, least_length, least, every), "spelling-words")
    pairs = stage(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("bn"))
    # the largest n first, then the smallest word, as the least of a struct
    best = F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("b"))).alias("best")
    near = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("formed", -F.col("best.less") >= factor * F.col("n"))
    made = stage(
        joined.select("word", F.when(F.col("formed"), F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.when(F.col("formed"), -F.col("best.less")).alias("form_n")), "spelling-forms"
    )
    roots = follow(made.where(F.col("form").isNotNull()))
    return made.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
