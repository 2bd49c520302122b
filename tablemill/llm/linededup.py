"""Line dedup by site-relative frequency.

Within a host (here the document's source) a line is boilerplate if it stands on more than a given
share of the host's pages, and on two of them at least: a line of one page repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage

#: Rows of a host's total that the counts of its lines are dealt over.
SALTS = 32


def line_key(line: Column) -> Column:
    """The line without white space at its ends; empty for a line of white space."""
    return F.regexp_replace(line, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")


def host_of(source: Column) -> Column:
    """A key that keeps a null host apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, ratio: float = 0.05, least: int = 2) -> DataFrame:
    """(host, lines): for each host the array of lines on more than ``ratio`` and at least ``least`` of its pages.

    Lines are counted by two 64-bit hashes, so texts are not shuffled, and at most one row per task,
    host and line meets the others.  A host has at most (lines per page) / ``ratio`` such lines, so the
    array is bounded whatever the host's size.
    """
    keyed = docs.select(host_of(F.col("source")).alias("host"), F.array_distinct(F.transform(lines_of(F.col("text")), line_key)).alias("lines"))
    each = keyed.select("host", F.explode("lines").alias("line")).where(F.col("line") != "")
    counted = (
        each.groupBy("host", F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("~"), "line")).alias("h2"))
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= least)
        .withColumn("salt", F.pmod("h1", F.lit(SALTS)))
    )
    totals = (
        keyed.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
        .select("host", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    frequent = counted.join(totals, ["host", "salt"]).where(F.col("pages") > ratio * F.col("total"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("h1", "h2"))).alias("marks"))


def dedup_lines(docs: DataFrame, ratio: float = 0.05, least: int = 2) -> DataFrame:
    """Every column of ``docs``, ``text`` without boilerplate lines, and n_dropped long.

    All occurrences of a boilerplate line go, lines of white space stay, and the order of the others
    is kept.  Lines are compared without white space at their ends.  Very long texts are cut into lines whole,
    in the task that holds them; a line exactly at the ratio stays.  A null text stays null; a null
    source is a host of its own; repeated rows count as pages of their own; a column n_dropped of
    ``docs`` is replaced; an empty table gives an empty table.
    """
    # stored, so that Spark knows how small it is before it plans how the documents meet it
    hosts = stage(boilerplate(docs, ratio, least), "boilerplate").select(F.col("host").alias("__host"), F.col("marks").alias("__marks"))
    rest = [c for c in docs.columns if c != "n_dropped"]
    # Spark broadcasts the hosts if they are small enough, else it splits the rows of hot hosts
    joined = docs.select(*(F.col(f"`{c}`") for c in rest), host_of(F.col("source")).alias("__key")).join(
        hosts, F.col("__key") == F.col("__host"), "left"
    )

    def stays(line: Column) -> Column:
        key = line_key(line)
        mark = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(F.lit("~"), key)).alias("h2"))
        return F.col("__marks").isNull() | (key == "") | ~F.array_contains("__marks", mark)

    kept = joined.withColumn("__kept", F.filter(lines_of(F.col("text")), stays))
    columns = [F.array_join("__kept", "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in rest]
    dropped = F.coalesce(F.size(lines_of(F.col("text"))) - F.size("__kept"), F.lit(0)).cast("long")
    return kept.select(*columns, F.when(F.col("text").isNull(), F.lit(0)).otherwise(dropped).alias("n_dropped"))


def dedup_sql(docs: str = "documents", ratio: float = 0.05, least: int = 2) -> str:
    """DuckDB SQL for (doc_id, text, n_dropped) of ``dedup_lines`` over the named table."""
    key = r"regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g')"
    return f"""
        with d as (select row_number() over () rid, doc_id, text, coalesce('=' || source, '') host from {docs}),
        l as (select rid, host, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from d),
        k as (select rid, host, pos, line, {key} ck from l),
        f as (select host, ck, count(distinct rid) pages from k where ck <> '' group by host, ck),
        t as (select host, count(*) total from d group by host),
        b as (select host, ck from f join t using (host) where pages >= {least} and pages > {ratio} * total),
        m as (select rid, pos, line, b.ck is not null gone from k left join b on b.host = k.host and b.ck = k.ck),
        r as (select rid, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') kept, count(*) filter (where gone) n from m group by rid)
        select doc_id, case when d.text is null then null else kept end as text, coalesce(n, 0)::bigint as n_dropped
        from d left join r using (rid)"""
