"""Preparation steps for a modelling table, each a function from DataFrame to DataFrame.

A step looks at the table through one aggregation; only that one row of column facts comes to
the driver, where it decides about columns.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions import dates
from tablemill.functions.names import clean_name, clean_names, date_columns, numeric_columns, strip_symbol, text_columns
from tablemill.operators.ordered import largest_gap
from tablemill.operators.summary import pair_moments
from tablemill.session import stage

SEPARATOR = " = "
MAX_NULL_SHARE = 0.15
ID_SHARE = 0.98
HIGH_SHARE = 0.10
MAX_VALUES = 100
MAX_UNREADABLE = 0.10
MAX_VIF = 10.0


def _facts(df: DataFrame, aggs: dict[str, Column], per_pass: int = 400) -> dict:
    """Run named aggregates in passes of bounded width; returns one small dictionary."""
    names, out = list(aggs), {}
    for i in range(0, len(names), per_pass):
        some = names[i:i + per_pass]
        row = df.agg(*[aggs[n].alias(f"f{j}") for j, n in enumerate(some)]).first()
        out.update({n: row[f"f{j}"] for j, n in enumerate(some)})
    return out


def q(name: str) -> Column:
    """Column by exact name, dots and blanks included."""
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value: it becomes null."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(q(c), F.lit(None).cast(k)) for c, k in kinds.items() if k in ("double", "float")})


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n): exact numbers of distinct known values, counted on 128-bit digests.

    No value travels, however long, and a task sends a column's digest once.
    """
    def digest(c: str) -> Column:
        value = q(c) + F.lit(0.0) if dict(df.dtypes)[c] in ("double", "float") else q(c)
        return F.unhex(F.md5(value.cast("string").cast("binary")))

    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), digest(c).alias("v")) for c in columns]))
    seen = df.select(each.alias("r")).select("r.column", "r.v").filter("v is not null").distinct()
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    found = seen.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(found, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))


def capped_counts(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """(column, n): numbers of distinct known values, exact up to ``most``; ``most`` + 1 stands for all above.

    A task keeps the first ``most`` + 1 different values of a column and does not look at it after that, so
    it sends so many digests at most: where a task has more the column has more, else it sends them all.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint")
    kinds, plain = dict(df.dtypes), ("string", "boolean", "tinyint", "smallint", "int", "bigint")

    def value(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return q(c) + F.lit(0.0)
        return q(c) if kinds[c] in plain else q(c).cast("string")

    def few(batches):
        seen: list[set] = [set() for _ in columns]
        for batch in batches:
            for known, column in zip(seen, batch.columns, strict=True):
                if len(known) <= most:
                    known.update(pc.unique(column.drop_null())[: most + 1].to_pylist())
        rows = [(i, hashlib.md5(repr(v).encode("utf-8", "surrogatepass")).digest()) for i, known in enumerate(seen) for v in itertools.islice(known, most + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["at", "v"])

    sent = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(few, "at int, v binary")
    found = sent.distinct().groupBy("at").agg(F.least(F.count(F.lit(1)), F.lit(most + 1)).alias("n"))
    listed = df.sparkSession.createDataFrame(list(enumerate(columns)), "at int, column string")
    return listed.join(found, "at", "left").select("column", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- sparse, high-cardinality and blown-out columns --------------------------------------

@dataclass(frozen=True)
class ColumnFacts:
    """Rows of the table and nulls and distinct values of each column; NaN counts as null."""

    rows: int
    nulls: dict[str, int]
    distinct: dict[str, int]

    def null_share(self, column: str) -> float:
        return self.nulls[column] / self.rows if self.rows else 0.0

    def distinct_share(self, column: str) -> float:
        return self.distinct[column] / self.rows if self.rows else 0.0


def column_facts(df: DataFrame) -> ColumnFacts:
    df = nan_to_null(df)
    found = _facts(df, {"rows": F.count(F.lit(1)), **{f"known {c}": F.count(q(c)) for c in df.columns}})
    distinct = {r["column"]: r["n"] for r in distinct_counts(df, df.columns).collect()}
    return ColumnFacts(found["rows"], {c: found["rows"] - found[f"known {c}"] for c in df.columns}, distinct)


def sparse_columns(df: DataFrame, threshold: float = MAX_NULL_SHARE, facts: ColumnFacts | None = None) -> list[str]:
    """Non-date columns whose share of nulls is above the threshold."""
    facts = facts or column_facts(df)
    dated = set(date_columns(df))
    return [c for c in df.columns if c not in dated and facts.null_share(c) > threshold]


def drop_sparse(df: DataFrame, threshold: float = MAX_NULL_SHARE, facts: ColumnFacts | None = None) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold, facts))


def unreadable_share(column: str) -> Column:
    """Share of cells that hold text other than a number; nulls count as numbers."""
    bad = q(column).isNotNull() & F.trim(q(column)).try_cast("double").isNull()
    return F.try_divide(F.count_if(bad), F.count(F.lit(1)))


def repair_number(df: DataFrame, column: str) -> DataFrame:
    """Text to number; cells that cannot be read become null.

    The published function loses the whole column when it meets text other than a blank.
    """
    return df.withColumn(column, F.trim(q(column)).try_cast("double"))


def cardinality_actions(df: DataFrame, facts: ColumnFacts | None = None) -> dict[str, str]:
    """``drop``, ``repair`` or ``keep`` for each column from its share of distinct values."""
    facts = facts or column_facts(df)
    dated = set(date_columns(df))
    share = {c: facts.distinct_share(c) for c in df.columns}
    doubtful = [c for c in text_columns(df) if HIGH_SHARE <= share[c] < ID_SHARE]
    bad = _facts(df, {c: unreadable_share(c) for c in doubtful}) if doubtful else {}
    out = {}
    for c in df.columns:
        if c in dated or share[c] < HIGH_SHARE:
            out[c] = "keep"
        elif share[c] >= ID_SHARE:
            out[c] = "drop"
        elif c not in bad:
            out[c] = "keep"
        else:
            out[c] = "repair" if bad[c] <= MAX_UNREADABLE else "drop"
    return out


def handle_cardinality(df: DataFrame, facts: ColumnFacts | None = None) -> DataFrame:
    for c, action in cardinality_actions(df, facts).items():
        if action == "drop":
            df = df.drop(c)
        elif action == "repair":
            df = repair_number(df, c)
    return df


def blown_columns(df: DataFrame, threshold: int = MAX_VALUES, facts: ColumnFacts | None = None) -> list[str]:
    """Columns that are neither numbers nor dates and have more distinct values than the threshold."""
    facts = facts or column_facts(df)
    other = [c for c in df.columns if c not in {*numeric_columns(df), *date_columns(df)}]
    return [c for c in other if facts.distinct[c] > threshold]


def drop_blown(df: DataFrame, threshold: int = MAX_VALUES, facts: ColumnFacts | None = None) -> DataFrame:
    return df.drop(*blown_columns(df, threshold, facts))


# ---- dates -------------------------------------------------------------------------------

def excel_date_columns(df: DataFrame, now: str) -> list[str]:
    """Numeric columns that read as spreadsheet dates: nine in ten convertible, a range of more
    than a day, after 1970-01-01 and less than 3,650 days ahead of ``now``."""
    columns = numeric_columns(df)
    if not columns:
        return []
    aggs = {}
    for c in columns:
        at = lambda x: dates.excel_to_timestamp(F.when(dates.excel_is_readable(x), x))
        x = q(c).cast("double")
        low, high = at(F.min(x)), at(F.max(x))
        limit = F.lit(now).cast("timestamp") + F.expr("interval 3650 days")
        readable = F.try_divide(F.count_if(dates.excel_is_readable(x)), F.count(x))
        aggs[c] = ((readable >= 0.9) & (F.unix_micros(high) - F.unix_micros(low) > 86_400 * 10**6)
                   & (low > F.lit("1970-01-01").cast("timestamp")) & (high < limit))
    found = _facts(df, aggs)
    return [c for c in columns if found[c]]


def handle_dates(df: DataFrame, source_type: str, now: str) -> DataFrame:
    """Text that parses in full becomes timestamps; so do numbers that read as spreadsheet serials in csv
    and excel input, and numbers that read as nanoseconds since 1970 in other input."""
    text = text_columns(df)
    facts = {}
    for c in text:
        facts[f"{c}|bad"] = F.count(F.when(q(c).isNotNull() & dates.parse_date(q(c)).isNull(), 1))
        facts[f"{c}|day"] = F.count_if(dates.is_dayfirst(q(c)))
        facts[f"{c}|month"] = F.count_if(dates.is_monthfirst(q(c)))
        facts[f"{c}|n"] = F.count(q(c))
    found = _facts(df, facts) if facts else {}
    for c in text:
        if found[f"{c}|n"] and found[f"{c}|bad"] == 0:
            df = df.withColumn(c, dates.parse_date(q(c), dayfirst=found[f"{c}|day"] > found[f"{c}|month"]))
    if source_type in ("csv", "excel"):
        for c in excel_date_columns(df, now):
            df = df.withColumn(c, dates.excel_to_timestamp(q(c)))
        return df
    numeric = numeric_columns(df)
    found = _facts(df, {c: dates.is_nanoseconds(q(c)) for c in numeric}) if numeric else {}
    return df.withColumns({c: dates.nanoseconds_to_timestamp(q(c)) for c in numeric if found[c]})


# ---- nulls -------------------------------------------------------------------------------

def impute_means(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    means = _facts(df, {c: F.avg(q(c).cast("double")) for c in numeric}) if numeric else {}
    return df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(m)) for c, m in means.items() if m is not None})


def handle_nulls(df: DataFrame, mode: str = "drop") -> DataFrame:
    """``drop`` deletes rows with a null when they are under 1 % of all, otherwise numbers get their mean;
    ``mean`` always fills numbers.  Text keeps its nulls."""
    df = nan_to_null(df)
    if mode not in ("drop", "mean"):
        return df
    if mode == "drop":
        any_null = F.lit(False)
        for c in df.columns:
            any_null = any_null | q(c).isNull()
        share = _facts(df, {"s": F.try_divide(F.count_if(any_null), F.count(F.lit(1)))})["s"]
        if (share or 0) < 0.01:
            return df.na.drop()
    return impute_means(df)


# ---- multicollinearity -------------------------------------------------------------------

def cross_products(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Matrix of sums of products of (1, x1, x2 …) over the rows where all are known, in one pass for any width."""
    known = nan_to_null(df.select(*[q(c).cast("double").alias(c) for c in columns])).na.drop()
    m = pair_moments(known, columns)
    n, mean = m["n"][0, 0], m["mean"]
    sums = np.diag(m["s"])  # over complete rows the same for every partner
    out = np.zeros((len(columns) + 1, len(columns) + 1))
    out[0, 0] = n
    out[0, 1:] = out[1:, 0] = sums + n * mean
    out[1:, 1:] = m["p"] + np.outer(mean, sums) + np.outer(sums, mean) + n * np.outer(mean, mean)
    return out


class Factors:
    """Variance inflation factors of a set of columns that shrinks; column 0 is the intercept.

    All factors come from the inverse of the scaled cross products: its diagonal is one over what a column
    leaves unexplained.  Removing a column is a rank-one downdate.  Where the products are singular, a column
    takes part in a dependence if it has a share in the null space; its factor is infinite, and those of the
    others come from the pseudo-inverse.
    """

    NONE, SMALL, REFRESH = 1e-12, 1e-10, 50

    def __init__(self, products: np.ndarray, chosen: Sequence[int]):
        self.products, self.chosen = products, list(chosen)
        self._solve()

    def _solve(self) -> None:
        part = self.products[np.ix_(self.chosen, self.chosen)]
        scale = np.sqrt(np.diag(part))
        scale[scale == 0] = 1.0
        values, vectors = np.linalg.eigh(part / np.outer(scale, scale))
        none = values <= self.NONE * max(len(values), 1)
        kept = vectors[:, ~none]
        self.inverse, self.null, self.downdates = (kept / values[~none]) @ kept.T, vectors[:, none], 0

    def _totals(self, without: int | None = None) -> np.ndarray:
        """Each column's total over its own square sum: centred if the intercept is among the others."""
        square = np.diag(self.products)[self.chosen]
        total = np.ones(len(self.chosen))
        if 0 in self.chosen and without != 0:
            cross = self.products[self.chosen, 0] ** 2 / self.products[0, 0]
            total = np.where(square > 0, 1 - cross / np.where(square > 0, square, 1), 1.0)
            total[self.chosen.index(0)] = 1.0
        return total

    def _of(self, diagonal: np.ndarray, total: np.ndarray, dependent: np.ndarray) -> np.ndarray:
        endless = dependent | (diagonal >= 1 / self.SMALL) | (diagonal <= 0)
        return np.where(endless, np.inf, total * np.where(endless, 1.0, diagonal))

    def all(self) -> np.ndarray:
        if len(self.chosen) == 1:
            return np.ones(1)
        shares = (self.null**2).sum(axis=1)
        return self._of(np.diag(self.inverse), self._totals(), shares > 1e-8)

    def means_without(self) -> np.ndarray:
        """The mean factor of the others for each column that might go."""
        n = len(self.chosen)
        if n == 1:
            return np.zeros(1)
        if n == 2:
            return np.ones(2)
        out = np.full(n, np.inf)
        if self.null.shape[1] > 1:  # one column less leaves a dependence
            return out
        diagonal = np.diag(self.inverse)
        for k in range(n):
            if self.null.shape[1]:
                v = self.null[:, 0]
                if v[k] ** 2 <= 1e-8:
                    continue
                ratio = v / v[k]
                left = diagonal - 2 * ratio * self.inverse[k] + ratio**2 * diagonal[k]
            else:
                left = diagonal - self.inverse[k] ** 2 / diagonal[k]
            found = self._of(left, self._totals(self.chosen[k]), np.zeros(n, dtype=bool))
            out[k] = np.delete(found, k).mean()
        return out

    def remove(self, at: int) -> None:
        gone, self.chosen = self.inverse[at], [c for i, c in enumerate(self.chosen) if i != at]
        if self.null.shape[1] or self.downdates >= self.REFRESH or gone[at] >= 1 / self.SMALL:
            return self._solve()
        left = np.delete(gone, at)
        self.inverse = np.delete(np.delete(self.inverse, at, 0), at, 1) - np.outer(left, left) / gone[at]
        self.null, self.downdates = self.null[:-1], self.downdates + 1


def vifs(products: np.ndarray, chosen: Sequence[int]) -> list[float]:
    """Variance inflation factor of each chosen column; column 0 is the intercept.

    With the intercept among the others the total is centred, otherwise it is not.
    """
    return Factors(products, chosen).all().tolist()


def removals(products: np.ndarray, threshold: float) -> list[int]:
    """Columns removed one by one until no factor exceeds the threshold; 0 is the intercept."""
    factors, removed = Factors(products, range(len(products))), []
    rounded = lambda values: [float(f"{v:.9g}") for v in values]
    while factors.chosen:
        # equal up to rounding noise counts as equal: then the first column goes, on every run
        found = rounded(factors.all())
        worst = max(found)
        if not worst > threshold:
            break
        means = rounded(factors.means_without()) if np.isinf(worst) else None
        at = found.index(worst) if means is None else means.index(min(means))
        removed.append(factors.chosen[at])
        factors.remove(at)
    return removed


def collinear_columns(df: DataFrame, columns: Sequence[str], threshold: float = MAX_VIF) -> list[str]:
    """Names removed one by one until no factor exceeds the threshold.

    The largest factor goes; when it is infinite, the column whose absence gives the lowest mean
    factor goes instead.  The intercept may be removed, after which totals are not centred.
    """
    if len(columns) < 2:
        return []
    return [columns[i - 1] for i in removals(cross_products(df, columns), threshold) if i]


# ---- dummy columns -----------------------------------------------------------------------

def value_text(value) -> str:
    return str(value)


def category_values(df: DataFrame, label: str | None, few: int = 5, limit: int = MAX_VALUES) -> dict[str, list]:
    """Sorted values of text columns and of all others (numbers, flags, dates) with at most ``few`` values, label left out.

    Columns above ``limit`` values are refused: they must go before (see ``drop_blown``).
    """
    text = text_columns(df)
    plain = ("array", "map", "struct", "binary", "variant")
    candidates = [c for c, kind in df.dtypes if c != label and not kind.startswith(plain)]
    distinct = {r["column"]: r["n"] for r in capped_counts(df, candidates, max(few, limit)).collect()}
    chosen = [c for c in candidates if c in text or distinct[c] <= few]
    too_many = [c for c in chosen if distinct[c] > limit]
    if too_many:
        raise ValueError(f"columns with more than {limit} values: {too_many}")
    values = _facts(df, {c: F.array_sort(F.collect_set(q(c))) for c in chosen}) if chosen else {}
    return values


def dummy_columns(df: DataFrame, label: str | None = None, few: int = 5) -> tuple[DataFrame, dict[str, list[str]]]:
    """0/1 columns named ``column = value`` in place of the categories, and the parent -> children map.

    A null gives 0 in every child.
    """
    values = category_values(df, label, few)
    memory = {c: [f"{c}{SEPARATOR}{value_text(v)}" for v in vs] for c, vs in values.items()}
    kept = [q(c) for c in df.columns if c not in values]
    made = [F.when(q(c).eqNullSafe(F.lit(v)), 1).otherwise(0).alias(name)
            for c, vs in values.items() for v, name in zip(vs, memory[c])]
    return df.select(*kept, *made), memory


def memory_table(spark, memory: dict[str, list[str]]) -> DataFrame:
    rows = [(parent, child) for parent, children in memory.items() for child in children]
    return spark.createDataFrame(rows, "parent string, child string")


def recode_label(df: DataFrame, label: str, positive) -> DataFrame:
    """Two-valued label to 1 (positive) and 0, compared in the label's own type.

    Any other number of values is an error, and so is a positive value that does not occur.
    """
    kind = df.schema[label].dataType.simpleString()
    wanted = F.lit(str(positive)) if kind == "string" else F.lit(positive).try_cast(kind)
    found = df.select(q(label).alias("v")).filter("v is not null").distinct().select("v", (F.col("v") == wanted).alias("hit")).limit(3).collect()
    if len(found) != 2:
        raise ValueError(f"{label} must have two values, it has {'more' if len(found) > 2 else len(found)}")
    if not any(r["hit"] for r in found):
        raise ValueError(f"{label} never takes the positive value {positive!r}")
    return df.withColumn(label, F.when(q(label) == wanted, 1).when(q(label).isNotNull(), 0))


# ---- columns for time series -------------------------------------------------------------

def time_columns(df: DataFrame, max_gap_days: int = 365, max_null_share: float = 0.5) -> list[str]:
    """Date columns without a gap above a year and with at most half of the cells missing."""
    dated = date_columns(df)
    shares = _facts(df, {c: F.try_divide(F.count(F.lit(1)) - F.count(q(c)), F.count(F.lit(1))) for c in dated}) if dated else {}
    filled = [c for c in dated if (shares[c] or 0) <= max_null_share]
    if not filled:
        return []
    # all columns in one table of moments: one pass, one job
    moments = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.unix_micros(q(c).cast("timestamp")).alias("at")) for c in filled]))
    single = stage(df.select(moments.alias("m")).select("m.column", "m.at").filter("at is not null").distinct(), "moments")
    gaps = {r["column"]: r["max_gap"] or 0 for r in largest_gap(single, "at", ["column"]).collect()}
    return [c for c in filled if gaps.get(c, 0) <= max_gap_days * 86_400 * 10**6]


def feature_columns(df: DataFrame, low: float = 0.05, high: float = 0.95) -> list[str]:
    """Other columns without indicators that are almost never or almost always set."""
    dated, numeric = set(date_columns(df)), set(numeric_columns(df))
    others = [c for c in df.columns if c not in dated]
    facts = {}
    for c in others:
        if c in numeric:
            facts[f"{c}|flag"] = F.count_if(q(c).isin(0, 1)) == F.count(F.lit(1))
            facts[f"{c}|mean"] = F.avg(q(c))
    found = _facts(df, facts) if facts else {}
    return [c for c in others if c not in numeric or not found[f"{c}|flag"] or low <= (found[f"{c}|mean"] or 0) <= high]


# ---- the whole chain ---------------------------------------------------------------------

@dataclass(frozen=True)
class PrepareConfig:
    label: str
    positive: object
    block_list: tuple[str, ...] = ()
    source_type: str = "csv"
    na_handling: str = "drop"
    training: bool = True
    now: str = "2020-01-01"


@dataclass
class Prepared:
    before_dummies: DataFrame
    with_dates: DataFrame
    table: DataFrame
    memory: dict[str, list[str]]
    time_columns: list[str]
    feature_columns: list[str]
    report: list[tuple[str, str]] = field(default_factory=list)

    def report_table(self) -> DataFrame:
        return self.table.sparkSession.createDataFrame(self.report, "step string, columns string")


def prepare(raw: DataFrame, config: PrepareConfig) -> Prepared:
    """Run all steps in their fixed order and note the columns that each one removed."""
    report: list[tuple[str, str]] = []
    label = clean_name(config.label)

    def step(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
        gone = [c for c in before.columns if c not in after.columns]
        report.append((name, ", ".join(gone)))
        return after

    df = step("block list", raw, nan_to_null(raw.drop(*config.block_list)))
    df = step("names", df, clean_names(df))
    df = step("symbols", df, strip_symbol(df))
    df = step("dates", df, handle_dates(df, config.source_type, config.now))
    # texts are parsed once; every later look at the table reads the stored columns it needs
    df = stage(df, "prepare-parsed")
    facts = column_facts(df)
    df = step("sparse", df, drop_sparse(df, facts=facts))
    df = step("cardinality", df, handle_cardinality(df, facts))
    df = step("blow-out", df, drop_blown(df, facts=facts))
    df = step("nulls", df, handle_nulls(df, config.na_handling))
    numeric = [c for c in numeric_columns(df) if c != label]
    removed = collinear_columns(df, numeric)
    df = step("collinear", df, df.drop(*removed))
    before_dummies = df
    df, memory = dummy_columns(df, label)
    step("dummies", before_dummies, df)
    if config.training:
        df = recode_label(df, label, config.positive)
    dated = date_columns(df)
    return Prepared(before_dummies, df, df.drop(*dated), memory, time_columns(df), feature_columns(df), report)


