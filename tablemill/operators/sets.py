"""Set operators on tables, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage


def compare_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersection, difference and symmetric difference of two key sets in one grouping."""
    keys = left.columns
    sides = left.select("*", F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select("*", F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    seen = sides.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    in_left, in_right = F.col("__l") == 1, F.col("__r") == 1
    ops = F.array_compact(F.array(
        F.when(in_left & in_right, "both"), F.when(in_left & ~in_right, "only_left"), F.when(in_left != in_right, "one_of")))
    return seen.select(F.explode(ops).alias("op"), *keys)


def keep_members(items: Column, members: Column) -> Column:
    """Items that occur in ``members``; repeated items stay."""
    return F.filter(items, lambda x: F.array_contains(members, x))


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right value wins."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def _prefixes(sets: DataFrame, last: Column) -> DataFrame:
    """A row for each item behind place ``last`` of the set, which joins the items of the ``key``."""
    later = F.explode(F.transform(F.slice("set", last + 1, F.size("set")), lambda x, i: F.struct(x.alias("item"), (last + i).cast("int").alias("at"))))
    return sets.select("key", "set", later.alias("p")).select(F.array_append("key", F.col("p.item")).alias("key"), "set", (F.col("p.at") + 1).alias("at"))


def strict_subsets(sets: DataFrame, many: int = 1_000_000) -> DataFrame:
    """The rows of the distinct, sorted arrays ``set`` that are strict subsets of another row.

    An inverted index on the rarest items: a set looks for larger ones among those that hold its rarest
    item, and compares itself with them.  Where that would be more than ``many`` pairs, they have to hold
    its second rarest item as well, and so on.  A set all of whose items are asked for needs no comparing: it
    is a subset if any larger set is there.
    """
    each = sets.select("set", F.explode("set").alias("item"))
    often = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(often, "item").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("by"))
    ordered = stage(ordered.select(F.col("by.item").alias("set"), F.col("set").alias("own")), "subset-sets")
    start = ordered.select("set", "own", F.slice("set", 1, 0).alias("key"))
    asking, holding = start, start.withColumn("at", F.lit(0))
    found, depth = [], 0
    while True:
        depth += 1
        asking = asking.where(F.size("set") >= depth).select("set", "own", F.slice("set", 1, depth).alias("key"))
        asked = stage(asking, "subset-asked")
        holding = stage(_prefixes(holding, F.col("at")).join(asked.select("key").distinct(), "key", "left_semi"), "subset-held")
        most = holding.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.size("set")).alias("largest"))
        spent = asked.where(F.size("set") == depth).join(most, "key").where(F.col("largest") > depth)
        found.append(spent.select("own"))
        left = asked.where(F.size("set") > depth)
        pairs = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(most, "key").select("key", (F.col("n") * F.col("m") > many).alias("hot"))
        pairs = stage(pairs, "subset-keys")
        few = left.join(pairs.where("not hot"), "key").alias("a").join(holding.alias("b"), F.col("a.key") == F.col("b.key"))
        inside = (F.size("b.set") > F.size("a.set")) & (F.size(F.array_except("a.set", "b.set")) == 0)
        found.append(few.where(inside).select("a.own"))
        hot = pairs.where("hot").select("key")
        if hot.isEmpty():
            break
        asking, holding = left.join(hot, "key", "left_semi"), holding.join(hot, "key", "left_semi")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.select(F.col("own").alias("set")).distinct()


def drop_strict_subsets(baskets: DataFrame, items: str) -> DataFrame:
    """Remove rows whose item array is, as a set, a strict subset of another row's; baskets of any size.

    Null items are no items.  The empty set is a strict subset of every other; rows of equal sets and rows without a set (null) stay.
    """
    own = F.array_sort(F.array_distinct(F.array_compact(F.col(items))))
    marked = baskets.withColumn("__set", own)
    sets = stage(marked.where(F.size("__set") > 0).select(F.col("__set").alias("set")).distinct(), "subset-baskets")
    gone = strict_subsets(sets).select(F.col("set").alias("__gone"))
    kept = marked.join(gone, F.col("__set") == F.col("__gone"), "left_anti")
    if not sets.isEmpty():
        kept = kept.where(F.col("__set").isNull() | (F.size("__set") > 0))
    return kept.drop("__set")


def upsert(store: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Rows of ``update`` replace the stored rows of the same key; other rows stay."""
    fresh = update.select(key, *[F.col(c).alias(f"__{c}") for c in update.columns if c != key], F.lit(True).alias("__hit"))
    joined = store.join(fresh, key, "left")
    return joined.select(key, *[
        F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in store.columns if c != key])
