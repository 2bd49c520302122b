"""Mixing sources to target weights.

Sources share the words of the corpus by weight, but none is repeated more than a given number of
times; what is over is shared out again among the others.  A source's repetition rate is its target
over its size.  A document is taken floor(rate) times, and once more with a probability of the rest of
the rate, drawn from a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.ordered import positions, running_sums
from tablemill.session import stage

#: Up to so many sources meet the documents by broadcast.  Of more, only those with more than SHARE of the
#: documents do, which are at most 1 / SHARE.
BROADCAST = 100_000
SHARE = 0.001


def words_in(text: Column) -> Column:
    """Number of runs of other than white space; a run and the blanks behind it become one mark."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(F.ltrim(marks, F.lit(" \t\n\x0b\f\r"))).cast("long")


def draw_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 (never 1) that id, text and seed decide."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_plan(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    The n-th source by code point (null last) has the n-th weight, repeating.  Targets add up to all
    sizes: in the order of the level at which sources reach ``limit`` times their size, those are full
    whose level is not above the one that the rest would get.  Sources are numbered and summed in
    ranges, so there may be any number of them.
    """
    known = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    late = F.col("source").isNull()
    numbered = positions(known.withColumn("late", late), [F.col("late"), F.col("source")], on=["late", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.select("source", "source_size", "n_docs", "pos", weight.alias("weight"), (F.lit(float(limit)) * F.col("source_size")).alias("cap"))
    capped = stage(capped.withColumn("level", F.col("cap") / F.col("weight")), "mix-caps")
    total, all_weight = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    upto = running_sums(capped, [F.col("level"), F.col("pos")], ["level", "pos"], {"caps": F.col("cap"), "weights": F.col("weight")})
    # sums that end before the row itself
    left, open_weight = F.lit(total) - F.col("caps") + F.col("cap"), F.lit(all_weight) - F.col("weights") + F.col("weight")
    marked = stage(upto.withColumn("full", F.col("cap") * open_weight <= left * F.col("weight")), "mix-full")
    spent, freed = marked.where("full").agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    shared = F.lit(total - spent) * F.col("weight") / F.lit(all_weight - freed)
    return marked.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("cap")).otherwise(shared).alias("target"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), limit: float = 3.0, seed: int = 17) -> DataFrame:
    """Every column of ``docs`` and size, source_size, target, copies (how often the mix takes the row).

    Sizes are words.  A null text has none and costs nothing; a source without words has target 0 and
    is not taken.  A null source is a source of its own, the last.  Which rows are taken once more is
    drawn from id and text, whatever the order of the rows: reruns agree, and rows that are equal in
    both share their draw.  Columns of ``docs`` with a result's name are replaced; an empty table
    gives an empty table.  A very long text is counted in one pass without being cut into words.
    Documents meet the targets by a broadcast of a counted size; of very many sources only the hot ones
    do, and the documents of the others by a join in which no key holds more than SHARE of them.
    """
    made = ("size", "source_size", "target", "copies")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    sized = docs.select(*rest, words_in(F.col("text")).alias("size"))
    plan = stage(source_plan(sized.select("source", "size"), weights, limit), "mix-plan")
    known, everything = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    plan = plan.select(key.alias("__source"), "n_docs", F.struct("source_size", "target").alias("__plan"))
    sized, same = sized.withColumn("__key", key), F.col("__key") == F.col("__source")
    if known <= BROADCAST:
        met = sized.join(F.broadcast(plan.drop("n_docs")), same)
    else:
        hot = F.broadcast(plan.where(F.col("n_docs") > SHARE * everything).drop("n_docs"))
        cold = plan.where(F.col("n_docs") <= SHARE * everything).drop("n_docs")
        met = sized.join(hot, same).unionByName(sized.join(hot, same, "left_anti").join(cold, same))
    own = F.col("__plan")
    rate = F.when(own["source_size"] > 0, F.least(own["target"] / own["source_size"], F.lit(float(limit)))).otherwise(0.0)
    more = draw_of(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)
    return met.select(
        *rest, "size", own["source_size"].alias("source_size"), own["target"].alias("target"), (F.floor(rate) + more.cast("long")).alias("copies")
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix_documents`` as often as they are taken, numbered by copy from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def mixing_sql(weights: Sequence[int] = (5, 2, 1), limit: float = 3.0, seed: int = 17) -> str:
    """DuckDB SQL for (doc_id, size, source_size, target, taken) over the documents."""
    return f"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size,
                          md5('{seed}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) mark from documents),
        s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) pos from d group by source),
        w as (select *, [{", ".join(str(w) for w in weights)}][((pos - 1) % {len(weights)} + 1)::int]::double weight, {limit}::double * source_size cap from s),
        u as (select *, sum(cap) over o caps, sum(weight) over o weights, (sum(source_size) over ())::double total, sum(weight) over () all_weight
              from w window o as (order by cap / weight, pos)),
        f as (select *, cap * (all_weight - weights + weight) <= (total - caps + cap) * weight as is_full from u),
        g as (select coalesce(sum(cap) filter (where is_full), 0) spent, coalesce(sum(weight) filter (where is_full), 0) freed from f),
        p as (select source, source_size, case when is_full then cap else (total - spent) * weight / (all_weight - freed) end target from f, g),
        r as (select doc_id, size, source_size, target, mark, case when source_size > 0 then least(target / source_size, {limit}::double) else 0.0::double end rate
              from d join p on d.source is not distinct from p.source)
        select doc_id, size, source_size, target,
               (size * (floor(rate) + case when ('0x' || mark[1:13])::bigint / {float(1 << 52)} < rate - floor(rate) then 1 else 0 end))::bigint taken
        from r"""
