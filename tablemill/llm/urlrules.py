"""URL filter: hand-written host and path rules, and association rules mined from what they judge.

FP-growth mines combinations of URL tokens that go with a label.  The labels are the verdicts of the
hand-written rules and of a few seed words; a URL that neither judges counts as evidence against a
combination, so that what is merely frequent is not blocked.  Rules that reach the support and the
confidence are matched through an inverted index on their rarest token.  Column functions only.
"""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage

#: The rules that the query is given (fixed values): verdict and host with path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words in a host that label a URL that no rule judges.
SEEDS = ("adult", "ads", "bets", "betting", "casino", "pills", "porn", "spam", "viagra", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host up to the first ``/``, ``?`` or ``#``, with A-Z lower-cased, and the path after it."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of size, verdict and rule; null if none does.

    The list is a short one, written by hand.  If a rule is listed with both verdicts, block holds.
    """
    found = []
    for verdict, rule in rules:
        own_host, own_path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    if not found:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    return F.array_max(F.array_compact(F.array(*found)))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host and their parts, words of the path, names in the query; digits become ``#``."""

    def marked(mark: str, parts: Column) -> Column:
        clean = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"[0-9]+", "#"))
        return F.transform(F.filter(clean, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, r"^([^=]*)", 1))
    return F.array_distinct(
        F.concat(
            marked("h:", F.split(host, r"[.]")), marked("h:", F.split(host, r"[.\-_]+")),
            marked("p:", F.split(path, r"[/._\-]+")), marked("q:", names),
        )
    )


def mined_rules(labelled: DataFrame, support: float, least: int, confidence: float) -> DataFrame:
    """(antecedent, verdict, confidence, support) from rows (tokens, label); label is null where unknown."""
    rows = labelled.count()
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if not rows:
        return labelled.sparkSession.createDataFrame([], schema)
    items = labelled.select(F.when(F.col("label").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array(F.concat(F.lit("="), "label")))).alias("items"))
    mined = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / rows)), minConfidence=confidence).fit(items)
    verdict = F.element_at("consequent", 1)
    return mined.associationRules.where((F.size("consequent") == 1) & verdict.startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("="))).select(
        F.sort_array("antecedent").alias("antecedent"), F.substring(verdict, 2, 10).alias("verdict"), "confidence", "support"
    )


def mining_rows(urls: DataFrame, masked: Column, support: float, least: int) -> DataFrame:
    """The rows (url, tokens, label) with only the tokens that mining has to look at.

    Tokens below the support, which no rule can hold, go, and so do ``masked`` ones.  Of tokens that always
    stand in the same URLs one speaks for all: adding another to a combination changes neither its support nor
    its confidence, so tokens that a site repeats on every page do not multiply the combinations.  Two sets of
    rows are told apart by their size and two sums of hashes.
    """
    each = urls.select("url", F.explode("tokens").alias("token")).where(~masked)
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "url").cast("decimal(38,0)"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), hashed(1).alias("h1"), hashed(2).alias("h2"))
    floor = max(float(least), support * urls.count())
    speakers = seen.where(F.col("n") >= floor).groupBy("n", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    kept = each.join(speakers, "token").groupBy("url").agg(F.collect_set("token").alias("tokens"))
    labels = urls.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("label"))
    # a URL that repeats is a row each time
    met = labels.join(kept, "url", "left").select(F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("turn"), "tokens", "label")
    return met.select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "label")


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, support: float = 0.001, least: int = 10, confidence: float = 0.8) -> DataFrame:
    """Every column of ``pages`` and host, path, rule (the listed one or null), verdict, mined (tokens of the mined rule or null).

    The listed rule's verdict holds, else that of the mined rule of the highest confidence (then the
    highest support, then block before allow, then the tokens in order), else allow.  What labels a URL (seed words, hosts and paths of the listed rules) stands in no
    mined rule, so the rules say what goes with it and reach URLs that hold neither.  A null URL, or
    one without ``://``, has an empty host and path.  Repeated rows are judged alike and all kept;
    columns of ``pages`` with a result's name are replaced; an empty table gives an empty table.
    """
    added = ("host", "path", "rule", "verdict", "mined")
    host, path = split_url(F.col("url"))
    rest = [f"`{c}`" for c in pages.columns if c not in added]
    urls = pages.select("url").withColumns({"host": host, "path": path})
    urls = urls.withColumns({"fit": listed(F.col("host"), F.col("path"), rules), "tokens": tokens_of(F.col("url"), F.col("host"), F.col("path"))})
    seeded = F.arrays_overlap("tokens", F.array(*(F.lit(f"h:{s}") for s in seeds))) if seeds else F.lit(False)
    label = F.coalesce(F.col("fit.verdict"), F.when(seeded, F.lit("block")))
    urls = stage(urls.withColumn("label", label), "urls")
    words = {f"h:{s}" for s in seeds} | {f"{mark}:{part}" for _, r in rules for mark, side in zip("hp", r.split("/", 1)) for part in re.split(r"[./]", side) if part}
    masked = F.col("token").isin(sorted(words))
    found = stage(mined_rules(stage(mining_rows(urls, masked, support, least), "url-tokens"), support, least, confidence), "rules")
    # each rule is listed under the token of its antecedent that the fewest URLs have
    often = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        found.withColumn("token", F.explode("antecedent"))
        .join(often, "token")
        .groupBy("antecedent", "verdict", "confidence", "support")
        .agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    )
    open_urls = urls.where("fit is null").select("url", "tokens").distinct()
    hits = (
        open_urls.withColumn("token", F.explode("tokens"))
        .join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("url")
        .agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("o"), "antecedent", "verdict")).alias("hit"))
        .select(F.col("url").alias("__url"), F.col("hit.verdict").alias("__verdict"), F.col("hit.antecedent").alias("__mined"))
    )
    judged = pages.withColumns({"__host": host, "__path": path}).withColumn("__fit", listed(F.col("__host"), F.col("__path"), rules))
    free = F.col("__fit").isNull()
    return judged.join(hits, F.col("url") == F.col("__url"), "left").select(
        *rest, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__fit.rule").alias("rule"),
        F.when(free, F.coalesce("__verdict", F.lit("allow"))).otherwise(F.col("__fit.verdict")).alias("verdict"),
        F.when(free, F.array_join("__mined", " ")).alias("mined"),
    )
