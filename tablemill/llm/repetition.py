"""Quality rules on repetition, by suffix arrays.

The suffix array of a text's words is built by prefix doubling, many texts at once; the longest common
prefixes of neighbours in it give, for every word, the longest passage from there that stands in the
text again.  Those that no repeat to the left contains are the maximal repeats.  Their spans are
united, and the covered share of the text and the longest repeat are limited.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import KIND, Powers

RUN = 1_000_000
WINDOW = 8
BLANKS = " \t\n\v\f\r"
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def suffix_array(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, order) of all suffixes; ``words`` are numbers, ``ends`` the end of each position's text.

    Suffixes of one text stand together and end with it; a suffix that is a prefix of another comes first.
    """
    n = len(words)
    order = np.lexsort((words, ends))
    same = np.r_[False, (words[order][1:] == words[order][:-1]) & (ends[order][1:] == ends[order][:-1])]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    tied = same | np.r_[same[1:], False]
    active, step = order[tied], 1
    while len(active):
        after = active + step
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        place = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], place, 0))
        same = np.r_[False, (first[1:] == first[:-1]) & (second[1:] == second[:-1])]
        head = np.maximum.accumulate(np.where(same, 0, place))
        rank[active] = first + head - begin
        active = active[same | np.r_[same[1:], False]]
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return rank, order


def common_prefixes(words: np.ndarray, ends: np.ndarray, rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the words that its suffix shares with the one before it in the suffix array.

    Where the neighbour moves along with the position, the value is the one before less one; only at
    the other positions words are compared, one step at all of them at once.
    """
    n = len(words)
    before = np.where(rank > 0, order[np.maximum(rank - 1, 0)], -1)
    before = np.where((before >= 0) & (ends[np.maximum(before, 0)] == ends), before, -1)
    shares = (before >= 0) & (words == words[np.maximum(before, 0)])
    follows = np.r_[False, (before[1:] == before[:-1] + 1) & shares[:-1] & (ends[1:] == ends[:-1])]
    out = np.zeros(n, dtype=np.int64)
    todo = np.flatnonzero(~follows & (before >= 0))
    size = np.zeros(len(todo), dtype=np.int64)
    live = np.arange(len(todo))
    while len(live):
        i, j = todo[live] + size[live], before[todo[live]] + size[live]
        inside = (i < ends[todo[live]]) & (j < ends[todo[live]])
        equal = inside & (words[np.minimum(i, n - 1)] == words[np.minimum(j, n - 1)])
        live = live[equal]
        size[live] += 1
    out[todo] = size
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.where(follows, np.maximum(out[start] - (np.arange(n) - start), 0), out)


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest passage from there that its text holds again."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    rank, order = suffix_array(words, ends)
    shared = common_prefixes(words, ends, rank, order)
    up = np.append(shared[order], 0)  # with the suffix before, in the order of the array
    return np.maximum(up[rank], up[rank + 1])


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the spans."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _measures(texts: list[str], least: int, powers: Powers) -> pd.DataFrame:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    bounds = np.r_[0, np.cumsum([len(r) + 1 for r in raw])]
    word = KIND[data] > 0
    per_text = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][bounds])
    start, stop = np.flatnonzero(word & ~np.r_[False, word[:-1]]), np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    keys = powers.hashes(data, start, stop)
    place = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(place, np.arange(len(texts) + 1))
    n_words = np.diff(first)
    words = np.unique(keys, return_inverse=True)[1]
    ends = first[1:][place]
    longest = longest_repeats(words, ends)
    n = len(words)
    windows = covered(np.flatnonzero(longest >= WINDOW), np.full(int((longest >= WINDOW).sum()), WINDOW), n)
    # maximal to the left: the passage from the word before does not contain this one
    maximal = (longest >= least) & ~np.r_[False, (longest[1:] < longest[:-1]) & (ends[1:] == ends[:-1])]
    spans = covered(np.flatnonzero(maximal), longest[maximal], n)
    per_words = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][first])
    top = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(top, place, longest)
    doubles = []
    for text in texts:
        seen: set[str] = set()
        lines = [line for line in text.split("\n") if line.strip(BLANKS)]
        seen.update(lines)
        doubles.append(len(lines) - len(seen))
    return pd.DataFrame({
        "n_words": n_words, "word_chars": per_text(word & ((data & 0xC0) != 0x80)), "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": doubles, "n_repeat_words": per_words(windows), "n_covered": per_words(spans), "longest_repeat": top,
    })


def repetition_rules(docs: DataFrame, least: int = 5, most_covered: float = 0.3, most_longest: float = 0.2) -> DataFrame:
    """doc_id and the measures of every document, base_failed and kept.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed are the base rules;
    n_covered counts the words in maximal repeats of at least ``least`` words, longest_repeat the words
    of the longest passage that stands twice, overlaps included.  kept is false if base_failed, or if
    the repeats cover more than ``most_covered`` of the words, or the longest one holds more than
    ``most_longest`` of them.

    A null or empty text has no words and fails the base rules; whole texts are read whatever their
    length.  Repeated rows and null ids are kept; further columns are ignored; an empty table gives an
    empty table.
    """

    def measure(batches):
        powers = Powers()
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            a = 0
            while a < len(texts):
                b, size = a + 1, len(texts[a])
                while b < len(texts) and size + len(texts[b]) <= RUN:
                    size += len(texts[b])
                    b += 1
                out = _measures(texts[a:b], least, powers)
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].to_numpy())
                yield out
                a = b

    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_covered longest_repeat".split()
    out = docs.select("doc_id", "text").mapInPandas(measure, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_longest * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine).select(
        "doc_id", *names[:5], "base_failed", "kept", *names[5:]
    )
