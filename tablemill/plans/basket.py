"""Market-basket analysis over a table of numeric columns.

A row's items are the columns whose value is at least 1.  Rows with the same items are summed
up first; everything after works on these signatures, whose number depends on the items and
not on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations as subsets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.names import numeric_columns
from tablemill.operators.joining import combinations
from tablemill.operators.sets import drop_strict_subsets
from tablemill.operators.sorting import top_per_group
from tablemill.operators.summary import correlation_matrix
from tablemill.plans.prepare import _facts, q
from tablemill.session import stage

# Support levels, largest item set, size of the rule list, share for the flags.
MIN_SUPPORT, FALLBACK_SUPPORT = 0.1, 0.001
MAX_ITEMS, MAX_RULES, FLAG_SHARE = 3, 100, 0.9
SAME_COLUMN = 0.99


def item_columns(df: DataFrame, label: str | None = None) -> list[str]:
    """Numeric columns that are 0 or less somewhere, without the label and without a later column
    that correlates at 0.99 or more with an earlier kept one."""
    numeric = numeric_columns(df)
    zero = _facts(df, {c: F.count_if(q(c) <= 0) > 0 for c in numeric})
    names = [c for c in numeric if zero[c] and c != label]
    if len(names) < 2:
        return names
    matrix = correlation_matrix(df, names)
    same = {f"{a}|{b}": matrix[i, j] for (i, a), (j, b) in subsets(list(enumerate(names)), 2)}
    dropped: set[str] = set()
    for a in names:
        for b in names:
            if a == b or a in dropped or b in dropped:
                continue
            corr = same[f"{a}|{b}"] if f"{a}|{b}" in same else same[f"{b}|{a}"]
            if corr >= SAME_COLUMN:
                dropped.add(b)
    return [c for c in names if c not in dropped]


def item_array(items: Sequence[str]) -> Column:
    """Sorted names of the columns that are set in the row."""
    return F.array_compact(F.array(*[F.when(q(c) >= 1, F.lit(c)) for c in sorted(items)]))


def signatures(df: DataFrame, items: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """Rows, and sum and count of each measure, per distinct item array."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        aggs += [F.sum(q(m)).alias(f"{m}|sum"), F.count(q(m)).alias(f"{m}|count")]
    return df.groupBy(item_array(items).alias("items")).agg(*aggs)


def frequent_itemsets(found: DataFrame, min_support: float, max_items: int = MAX_ITEMS) -> DataFrame:
    """Item sets of up to ``max_items`` items whose share of rows reaches ``min_support``: items, n, n_rows.

    Level by level: a set is made only where two frequent sets of one item less, equal but for the last
    item, meet in a signature, so what is not frequent is never spelt out further.
    """
    n_rows = found.agg(F.sum("n")).scalar()
    signs = stage(found.select(F.array_sort("items").alias("items"), "n").withColumn("sid", F.monotonically_increasing_id()), "basket-signs")

    def frequent(held: DataFrame) -> DataFrame:
        counted = held.groupBy("items").agg(F.sum("n").alias("n")).withColumn("n_rows", n_rows)
        return stage(counted.filter(F.col("n") >= F.col("n_rows") * min_support), "basket-level")

    held = signs.select("sid", "n", F.explode("items").alias("item")).select("sid", "n", F.array("item").alias("items"))
    level = frequent(held)
    out = level
    for k in range(2, max_items + 1):
        if level.isEmpty():
            break
        held = stage(held.join(level.select("items"), "items", "left_semi").select(
            "sid", "n", F.slice("items", 1, k - 2).alias("head"), F.element_at("items", -1).alias("last")), "basket-held")
        other = held.select("sid", "head", F.col("last").alias("next"))
        held = held.join(other, ["sid", "head"]).filter("last < next").select("sid", "n", F.concat("head", F.array("last", "next")).alias("items"))
        level = frequent(held)
        out = out.unionByName(level)
    return out.select("items", "n", "n_rows")


def rules(itemsets: DataFrame) -> DataFrame:
    """Both-sided rules with lift of at least 1 and finite conviction."""
    single = itemsets.select(F.col("items").alias("part"), F.col("n").alias("part_n"))
    split = None
    whole = itemsets.filter(F.size("items") >= 2)
    for k in range(1, MAX_ITEMS):
        part = whole.filter(F.size("items") > k).select(
            "items", "n", "n_rows", F.explode(combinations(F.col("items"), k)).alias("antecedents"))
        split = part if split is None else split.unionByName(part)
    split = split.withColumn("consequents", F.array_except("items", "antecedents"))
    a = single.select(F.col("part").alias("antecedents"), F.col("part_n").alias("a_n"))
    c = single.select(F.col("part").alias("consequents"), F.col("part_n").alias("c_n"))
    joined = split.join(a, "antecedents").join(c, "consequents")
    n, rows, an, cn = F.col("n"), F.col("n_rows"), F.col("a_n"), F.col("c_n")
    return (
        joined.filter((n * rows >= an * cn) & (n < an))
        .select("antecedents", "consequents", "items", (n / rows).alias("support"), (n / an).alias("confidence"),
                ((n * rows) / (an * cn)).alias("lift"), ((1 - cn / rows) / (1 - n / an)).alias("conviction"))
    )


def find_rules(found: DataFrame) -> DataFrame:
    """Rules at the usual support, or at the low one when nothing is frequent."""
    itemsets = stage(frequent_itemsets(found, MIN_SUPPORT), "basket-itemsets")
    if itemsets.isEmpty():
        itemsets = stage(frequent_itemsets(found, FALLBACK_SUPPORT), "basket-itemsets")
    return rules(itemsets)


def best_baskets(all_rules: DataFrame) -> DataFrame:
    """The 100 rules of highest lift, then one row per unordered item set."""
    text = [F.array_join("antecedents", ", "), F.array_join("consequents", ", ")]
    ranked = all_rules.withColumns({"__a": text[0], "__c": text[1]})
    top = ranked.orderBy(F.desc("lift"), "__a", "__c").limit(MAX_RULES)
    one = top_per_group(top, ["items"], [F.desc("lift"), F.col("__a"), F.col("__c")], 1)
    return one.select("items", F.array_join("items", ", ").alias("basket"), "support", "lift")


def flag_top(baskets: DataFrame, measures: Sequence[str], share: float = FLAG_SHARE) -> DataFrame:
    """``<measure>_highlight`` for values at or above the quantile; the list has at most 100 rows."""
    baskets = stage(baskets, "basket-flags")
    bounds = baskets.agg(F.struct(*[F.percentile(q(m), share).alias(f"b{i}") for i, m in enumerate(measures)])).scalar()
    return baskets.withColumns({f"{m}_highlight": F.when(q(m) >= bounds[f"b{i}"], 1).otherwise(0) for i, m in enumerate(measures)})


def specific_baskets(baskets: DataFrame) -> DataFrame:
    """Without baskets that are strict subsets of another listed basket."""
    return drop_strict_subsets(baskets, "items")


def basket_measures(baskets: DataFrame, found: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sum, mean and count of each measure inside each basket and in the whole table, with flags.

    The at most 100 baskets are one row, against which every signature is held.
    """
    sums = [F.sum(q(f"{m}|{p}")).alias(f"{m}|{p}") for m in measures for p in ("sum", "count")]
    listed = baskets.agg(F.collect_list("items")).scalar()
    hits = F.filter("listed", lambda b: F.size(F.array_except(b, F.col("items"))) == 0)
    inside = found.withColumn("listed", listed).withColumn("basket", F.explode(hits)).groupBy(F.col("basket").alias("items")).agg(*sums)
    population = found.agg(F.struct(*sums)).scalar()
    columns = {}
    for m in measures:
        s, n = F.col(f"`{m}|sum`").cast("double"), F.col(f"`{m}|count`")
        ps, pn = population[f"{m}|sum"].cast("double"), population[f"{m}|count"]
        columns |= {f"{m}_basket_sum": s, f"{m}_basket_mean": s / n, f"{m}_basket_count": n,
                    f"{m}_pop_sum": ps, f"{m}_pop_mean": ps / pn, f"{m}_pop_count": pn}
    joined = baskets.join(inside, "items", "left").select(*baskets.columns, *[e.alias(n) for n, e in columns.items()])
    return flag_top(joined, list(columns))


def basket_report(df: DataFrame, items: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The whole analysis; signatures and baskets are stored once because several steps read them."""
    found = stage(signatures(df, items, measures), "basket-signatures")
    listed = stage(specific_baskets(flag_top(best_baskets(find_rules(found)), ["lift", "support"])), "basket-list")
    return basket_measures(listed, found, measures)
