"""Where stage files go, and rows that must not fall together."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablemill import session
from tablemill.functions import dates
from tablemill.operators import sorting
from tablemill.plans import prepare as prep
from tablemill.plans import profile, series
from tablemill.sources import readers


class Cluster:
    """A session that claims to run on a cluster."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": "spark://host:7077"})


@pytest.mark.parametrize("folder", [None, "", "/tmp/somewhere"])
def test_a_cluster_needs_a_shared_folder(folder):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster(folder))


def test_a_named_folder_is_used():
    assert session.shared_dir(Cluster("hdfs://name/dir/")) == "hdfs://name/dir"


def test_a_file_folder_is_tried(spark, tmp_path):
    session._try_folder(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="do not share"):
        session._try_folder(spark, "file:///proc/nowhere")


class Claiming:
    """A local session that claims to run on a cluster; ``named`` is its spark.checkpoint.dir."""

    def __init__(self, spark, named):
        self.spark = spark
        self.conf = {"spark.checkpoint.dir": named}
        self.sparkContext = type("Context", (), {"master": "local-cluster[3,4,10240]"})

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_a_folder_without_a_scheme_is_tried(spark, tmp_path):
    assert session.shared_dir(Claiming(spark, f"{tmp_path}/")) == str(tmp_path)
    assert list((tmp_path / "tablemill").glob("probe-*/part-*"))
    with pytest.raises(ValueError, match="do not share"):
        session.shared_dir(Claiming(spark, "/proc/nowhere"))


QUERIES = entry.queries()


@pytest.mark.parametrize("name", [  # one query for each step that stores
    "a28_tree_totals", "b03_rules", "b06_specific_baskets", "b07_basket_measures", "d12_series_columns", "d13_prepare_table", "j02_product", "j13_rising_pairs",
    "m02_oversample_minority", "m06_roc_area", "m07_fixed_scorer", "m08_weight_sentences",
])
def test_queries_store_in_a_folder_without_a_scheme(spark, sf_dir, tmp_path, monkeypatch, name):
    monkeypatch.setattr(session, "shared_dir", lambda s, real=session.shared_dir: real(Claiming(s, str(tmp_path))))
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert {p.parent.name.split("-")[0] for p in (tmp_path / "tablemill").glob("*/part-*")} > {"probe"}


def test_first_rows_of_null_and_odd_texts(spark):
    rows = [(1, None, "a"), (2, "\u0001", "a"), (3, "", "a"), (4, "x\u0000y", "z"), (5, "x", "y\u0000z"), (6, None, "a")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    assert sorted(r.id for r in sorting.keep_first(df, ["t", "u"], "id", long_text=True).collect()) == [1, 2, 3, 4, 5]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, None), (3.0, "a")], "x double, s string")
    facts = prep.column_facts(df)
    assert (facts.rows, facts.nulls, facts.distinct) == (4, {"x": 2, "s": 1}, {"x": 2, "s": 2})
    assert [r.x for r in prep.impute_means(df).collect()] == [1.0, 2.0, 2.0, 3.0]
    assert {r["column"]: (r.n_null, r.n_distinct) for r in profile.column_profile(df).collect()} == {"x": (2, 2), "s": (1, 2)}


def test_flags_and_days_become_dummies(spark):
    df = spark.createDataFrame([(True, "2020-01-01", 1.5), (False, "2020-01-02", 2.5), (None, None, 3.5)] * 4, "b boolean, d string, n double")
    out, memory = prep.dummy_columns(df.withColumn("d", F.col("d").cast("date")).withColumn("id", F.monotonically_increasing_id()), few=2)
    assert memory == {"b": ["b = False", "b = True"], "d": ["d = 2020-01-01", "d = 2020-01-02"]}
    assert out.agg(F.sum("`b = True`"), F.sum("`d = 2020-01-02`")).first()[:] == (4, 4)


@pytest.mark.parametrize(("text", "dayfirst", "want"), [
    ("1/2/2020", False, "2020-01-02 00:00:00"), ("1/2/2020", True, "2020-02-01 00:00:00"), ("05/02/2020 10:00:00", True, "2020-02-05 10:00:00"),
    ("2020-01-05T10:00:00", False, "2020-01-05 10:00:00"), ("2020-1-5", False, "2020-01-05 00:00:00"), ("Jan 5, 2020", False, "2020-01-05 00:00:00"),
    ("5th September 2020 7:30", False, "2020-09-05 07:30:00"), ("3/4/69", False, "1969-03-04 00:00:00"), ("3/4/68", False, "2068-03-04 00:00:00"),
    ("20200105", False, "2020-01-05 00:00:00"), ("31/31/2020", False, None), ("hello", False, None), ("", False, None), (None, False, None), ("2020-02-30", False, None),
    ("2020-01-05T10:00:00Z", False, "2020-01-05 10:00:00"), ("Smarch 1, 2020", False, None),
])
def test_date_texts(spark, text, dayfirst, want):
    row = spark.createDataFrame([(text,)], "t string").select(dates.parse_date(F.col("t"), dayfirst).cast("string").alias("d")).first()
    assert row["d"] == want


def test_a_stray_date_is_refused(spark):
    df = spark.createDataFrame([("a", "0001-01-01", 1.0), ("a", "2024-01-01", 2.0)], "k string, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    with pytest.raises(Exception, match="empty buckets"):
        series.resample(df, ["k"], "at", "v", "H").collect()
    assert series.resample(df, ["k"], "at", "v", "YS").count() == 2024


def test_workbooks_are_refused(spark):
    with pytest.raises(ValueError, match="workbook"):
        readers.read_source(spark, readers.SourceConfig("excel", "/data/book.XLSX"))
