"""Modelling and evaluation jobs (M, W10)."""

from pyspark.sql import functions as F

from tablemill.functions import text as tx
from tablemill.operators import scaling
from tablemill.operators.ordered import positions
from tablemill.plans import evaluate as ev
from tablemill.plans import modelling as md
from tablemill.plans import prepare as prep
from tablemill.registry import job
from tablemill.session import stage

UNIFORM = "(('0x' || left(md5({key} || '-{seed}'), 8))::BIGINT::DOUBLE / 4294967296)"
WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


def scored_labels(t):
    """Labels with a score: half a fixed random number, and 0.3 more for good rows, in steps of 0.01."""
    u = scaling.uniform_of(F.col("doc_id"), 3)
    score = F.floor((u * 0.5 + F.col("quality") * 0.3) * 100) / 100
    return t.labels.select("doc_id", F.col("quality").alias("label"), score.alias("score")).withColumn(
        "prediction", F.when(F.col("score") >= 0.4, 1).otherwise(0))


SCORED = f"""s AS (SELECT *, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS prediction FROM (SELECT doc_id, quality AS label,
    floor(({UNIFORM.format(key='doc_id', seed=3)} * 0.5::DOUBLE + quality * 0.3::DOUBLE) * 100) / 100 AS score FROM labels))"""


def document_features(t):
    """Training table: document measures and language dummies for the labelled documents."""
    docs = t.labels.join(t.documents, "doc_id").select(
        "doc_id", "quality", "n_chars", F.size(tx.words(F.col("text"))).alias("n_words"), F.size(tx.lines(F.col("text"))).alias("n_lines"),
        (F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("upper_share"), "lang")
    table, memory = prep.dummy_columns(stage(docs, "document-features"), label="quality", few=1)
    return table, memory


FEATURES = ["n_chars", "n_words", "n_lines", "upper_share", "lang = de", "lang = en", "lang = es", "lang = fr"]


def training(t):
    table, memory = document_features(t)
    split = scaling.train_test_split(table, "doc_id", 20, seed=5)
    return md.assemble(split, FEATURES, "quality").select("doc_id", "features", "label", "test"), memory


@job("w10_roc_points", f"""
    WITH {SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY 1)
    SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, (sum(p) OVER w)::DOUBLE / (SELECT sum(p) FROM g)::DOUBLE AS tpr,
      (sum(n) OVER w)::DOUBLE / (SELECT sum(n) FROM g)::DOUBLE AS fpr FROM g WINDOW w AS (ORDER BY score DESC)""")
def roc_points(t):
    return ev.roc_points(scored_labels(t)).drop("p", "n")


@job("m01_train_test_split", """
    SELECT doc_id, ('0x' || left(md5(doc_id || '-5'), 8))::BIGINT % 100 < 20 AS test FROM labels JOIN documents USING (doc_id)""")
def train_test_split(t):
    return scaling.train_test_split(t.labels.join(t.documents.select("doc_id"), "doc_id"), "doc_id", 20, seed=5).select("doc_id", "test")


@job("m02_oversample_minority", f"""
    WITH x AS (SELECT doc_id, quality, n_chars, CAST(len({WORDS}) AS INTEGER) AS n_words FROM labels JOIN documents USING (doc_id)
               WHERE NOT ('0x' || left(md5(doc_id || '-5'), 8))::BIGINT % 100 < 20),
      c AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM x),
      m AS (SELECT x.*, row_number() OVER (ORDER BY doc_id) AS pos, greatest(p, n) - least(p, n) AS need, least(p, n) AS small FROM x, c
            WHERE quality = CASE WHEN p < n THEN 1 ELSE 0 END),
      r AS (SELECT a.*, b.doc_id AS neighbour, b.n_chars AS n_chars_, b.n_words AS n_words_, row_number() OVER (PARTITION BY a.doc_id ORDER BY (a.n_chars - b.n_chars) ** 2 + (a.n_words - b.n_words) ** 2, b.doc_id) AS rank
            FROM m a JOIN m b ON a.doc_id <> b.doc_id),
      k AS (SELECT *, unnest(generate_series(1, need // small + CASE WHEN pos <= need % small THEN 1 ELSE 0 END)) AS copy FROM r WHERE rank <= 5)
    SELECT doc_id, neighbour, CAST(copy AS INTEGER) AS copy, u AS weight, n_chars + u * (n_chars_::DOUBLE - n_chars) AS n_chars, n_words + u * (n_words_::DOUBLE - n_words) AS n_words
    FROM (SELECT *, {UNIFORM.format(key="(doc_id || '/' || copy)", seed=10)} AS u FROM k
          WHERE rank = ('0x' || left(md5(doc_id || '/' || copy || '-9'), 8))::BIGINT % least(5, small - 1) + 1)""")
def oversample_minority(t):
    table = t.labels.join(t.documents, "doc_id").select("doc_id", "quality", "n_chars", F.size(tx.words(F.col("text"))).alias("n_words"))
    train = scaling.train_test_split(table, "doc_id", 20, seed=5).filter(~F.col("test"))
    return md.oversample_minority(train, "doc_id", "quality", ["n_chars", "n_words"], seed=9)


@job("m03_folds", """
    SELECT fold, count(*) AS n, count(*) FILTER (quality = 1) AS n_good FROM (
      SELECT quality, CAST(('0x' || left(md5(doc_id || '-11'), 8))::BIGINT % 5 AS INTEGER) AS fold FROM labels JOIN documents USING (doc_id)
      WHERE NOT ('0x' || left(md5(doc_id || '-5'), 8))::BIGINT % 100 < 20) GROUP BY 1""")
def folds(t):
    """Rows and good rows in each fold of the search."""
    table = scaling.train_test_split(t.labels.join(t.documents.select("doc_id"), "doc_id"), "doc_id", 20, seed=5).filter("not test")
    return md.with_folds(table, "doc_id", 5, 11).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"))


@job("m03_search_models")
def search_models(t):
    ready, _ = training(t)
    return md.search_models(ready.filter(~F.col("test")), "doc_id")[0]


@job("m04_linear_regression", """
    SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
      round(regr_slope(l_extendedprice, l_quantity) * 30 + regr_intercept(l_extendedprice, l_quantity), 4) AS at_30 FROM lineitem GROUP BY 1""")
def linear_regression(t):
    slope, start = F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(slope, 4).alias("slope"), F.round(start, 4).alias("intercept"), F.round(slope * 30 + start, 4).alias("at_30"))


LOSS = "avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END)"
METRICS_SQL = f"""{SCORED}, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM s),
  l AS (SELECT (SELECT {LOSS} FROM (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM s)) AS soft,
               (SELECT {LOSS} FROM (SELECT label, least(greatest(prediction, 1e-15), 1 - 1e-15) AS p FROM s)) AS hard)"""


@job("m05_classification_metrics", f"""
    WITH {METRICS_SQL} SELECT tp, fp, fn, tn, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2 * tp::DOUBLE / (2 * tp + fp + fn) AS f1,
      (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, round(soft, 6) AS log_loss, round(hard, 6) AS log_loss_hard FROM c, l""")
def classification_metrics(t):
    return ev.classification_metrics(scored_labels(t)).withColumns({c: F.round(c, 6) for c in ("log_loss", "log_loss_hard")})


AUC = """SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auc
    FROM (SELECT score FROM s WHERE label = 1) a, (SELECT score FROM s WHERE label = 0) b"""


@job("m06_roc_area", f"WITH {SCORED} {AUC}")
def roc_area(t):
    return ev.roc_area(ev.roc_points(scored_labels(t)))


@job("m07_permutation_importance")
def permutation_importance(t):
    ready, _ = training(t)
    model = md.LogisticRegression(maxIter=20).fit(ready.filter(~F.col("test")))
    return md.permutation_importance(model, ready.filter("test"), "doc_id", FEATURES, seed=21)


FIXED_RULE = md.LinearRule((0.25, -1.5, 2.0, -1.0), 0.5)


@job("m07_fixed_scorer", f"""
    WITH x AS (SELECT doc_id, quality = 1 AS good, n_chars AS a, len({WORDS}) AS b, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS c, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS d
               FROM labels JOIN documents USING (doc_id) WHERE ('0x' || left(md5(doc_id || '-5'), 8))::BIGINT % 100 < 20),
      o AS (SELECT x.*, turn, ('0x' || left(md5(doc_id || '-' || (21 + turn)), 8))::BIGINT AS h FROM x, range(5) r(turn)),
      m AS (SELECT *, coalesce(lead(s) OVER w, first_value(s) OVER w) AS z FROM (SELECT *, {{'a': a, 'b': b, 'c': c, 'd': d}} AS s FROM o) WINDOW w AS (PARTITION BY turn ORDER BY h, doc_id)),
      t AS (SELECT unnest(['', 'n_chars', 'n_words', 'lang = de', 'lang = en']) AS feature, unnest([[a, b, c, d], [z.a, b, c, d], [a, z.b, c, d], [a, b, z.c, d], [a, b, c, z.d]]) AS v, good FROM m),
      g AS (SELECT feature, count(*) FILTER ((v[1] * 0.25::DOUBLE - v[2] * 1.5::DOUBLE + v[3] * 2 - v[4] + 0.5::DOUBLE > 0) = good)::DOUBLE / count(*) AS accuracy FROM t GROUP BY 1)
    SELECT feature, (SELECT accuracy FROM g WHERE feature = '') - accuracy AS weight FROM g WHERE feature <> ''""")
def fixed_scorer(t):
    """The importance of four measures for a scorer whose weights are given."""
    lang = F.col("lang")
    docs = t.labels.join(t.documents, "doc_id").select(
        "doc_id", "quality", "n_chars", F.size(tx.words(F.col("text"))).alias("n_words"),
        F.when(lang == "de", 1).otherwise(0).alias("lang = de"), F.when(lang == "en", 1).otherwise(0).alias("lang = en"))
    names = ["n_chars", "n_words", "lang = de", "lang = en"]
    ready = md.assemble(scaling.train_test_split(docs, "doc_id", 20, seed=5).filter("test"), names, "quality")
    return md.permutation_importance(FIXED_RULE, ready, "doc_id", names, seed=21)


@job("m07_parent_importance")
def parent_importance(t):
    _, memory = document_features(t)
    return md.parent_importance(permutation_importance(t), memory)


@job("m08_tree_importance")
def tree_importance(t):
    ready, _ = training(t)
    return md.tree_importance(ready.filter(~F.col("test")), FEATURES)


@job("m08_weight_sentences")
def weight_sentences(t):
    ready, _ = training(t)
    return md.weight_sentences(ready.filter(~F.col("test")), FEATURES)


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@job("m09_feature_limits", """
    SELECT unnest(['p_size', 'p_retailprice']) AS feature, unnest([min(p_size)::DOUBLE, min(p_retailprice)]) AS min, unnest([max(p_size)::DOUBLE, max(p_retailprice)]) AS max
    FROM part WHERE NOT ('0x' || left(md5(p_partkey || '-1'), 8))::BIGINT % 100 < 20 UNION ALL SELECT 'p_type', NULL, NULL""")
def feature_limits(t):
    """Limits on the training rows; the dummy parent has none."""
    train = scaling.train_test_split(t.part, "p_partkey", 20, seed=1).filter(~F.col("test")).select("p_size", "p_retailprice", "p_type")
    table, memory = prep.dummy_columns(train, few=1)
    return md.parent_limits(md.feature_limits(table, table.columns), memory)


@job("m10_scored_sample")
def scored_sample(t):
    from tablemill.operators.sorting import seeded_sample

    ready, _ = training(t)
    model = md.LogisticRegression(maxIter=20).fit(ready.filter(~F.col("test")))
    scored = md.score(model, ready.filter("test")).select("doc_id", F.col("label").cast("int").alias("label"), "prediction", F.col("score").alias("pos_proba"))
    return seeded_sample(scored, "doc_id", 200, seed=42).orderBy("pos_proba", "doc_id")


SCENARIOS = """sc AS (SELECT p_partkey AS scenario, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 ELSE (SELECT p_size FROM part ORDER BY p_partkey LIMIT 1) END AS p_size,
      CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice + 50 ELSE (SELECT p_retailprice FROM part ORDER BY p_partkey LIMIT 1) END AS p_retailprice, p_type FROM part),
    lim AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE NOT ('0x' || left(md5(p_partkey || '-1'), 8))::BIGINT % 100 < 20)"""


@job("m11_what_if_rows", f"""
    WITH {SCENARIOS} SELECT scenario, CAST(p_size AS INTEGER) AS p_size, p_retailprice, p_size NOT BETWEEN a AND b AS p_size_outside, p_retailprice NOT BETWEEN c AND d AS p_retailprice_outside,
      {", ".join(f"CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END AS {chr(34)}p_type = {v}{chr(34)}" for v in _TYPES)} FROM sc, lim""")
def what_if_rows(t):
    train = scaling.train_test_split(t.part, "p_partkey", 20, seed=1).filter(~F.col("test")).select("p_size", "p_retailprice", "p_type")
    table, memory = prep.dummy_columns(train, few=1)
    key = F.col("p_partkey")
    changes = F.array(F.struct(F.lit("p_type").alias("column"), F.col("p_type").alias("value")),
                      F.struct(F.when(key % 3 == 0, "p_size").otherwise("p_retailprice").alias("column"),
                               F.when(key % 3 == 0, (F.col("p_size") * 2).cast("string")).otherwise((F.col("p_retailprice") + 50).cast("string")).alias("value")))
    scenarios = t.part.select(key.alias("scenario"), F.explode(changes).alias("c")).select("scenario", "c.*")
    base = t.part.orderBy("p_partkey").limit(1)
    rows = md.apply_scenarios(base, scenarios, {"p_size": "int", "p_retailprice": "double", "p_type": "string"})
    flagged = md.flag_outside(rows, md.feature_limits(table, table.columns), ["p_size", "p_retailprice"])
    return md.expand_dummies(flagged, memory)


@job("m11_what_if_scores")
def what_if_scores(t):
    """The edited rows scored again by a model of the training rows."""
    low = (F.substring("p_brand", 7, 1) < "3").cast("int").alias("target")
    train = scaling.train_test_split(t.part, "p_partkey", 20, seed=1).filter(~F.col("test")).select("p_size", "p_retailprice", "p_type", low)
    table, memory = prep.dummy_columns(train, label="target", few=1)
    features = [c for c in table.columns if c != "target"]
    model = md.LogisticRegression(maxIter=20).fit(md.assemble(table, features, "target"))
    scored = md.score(model, md.assemble(what_if_rows(t).withColumn("target", F.lit(0)), features, "target"))
    return scored.select("scenario", "p_size_outside", "p_retailprice_outside", "prediction", F.col("score").alias("pos_proba"))


@job("m12_svm_grid")
def svm_grid(t):
    ready, _ = training(t)
    return md.svm_grid(ready.filter(~F.col("test")), "doc_id")


@job("m13_run_summary", f"""
    WITH {METRICS_SQL}, a AS ({AUC}) SELECT run, 'scored labels' AS model_type, 'labels' AS file_name, 3 AS col_count, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2 * tp::DOUBLE / (2 * tp + fp + fn) AS f1,
      (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, round(soft, 6) AS log_loss, round(hard, 6) AS log_loss_hard, auc AS roc_auc, (SELECT count(*) FROM s) AS test_item_count,
      (SELECT count(*) FROM labels) AS row_count, 'quality' AS target, 'threshold=0.5' AS parameters, 'score=1.0' AS importances, 'first line; second line' AS analysis, true AS stamped, true AS timed
    FROM c, l, a, (SELECT unnest(['first', 'second']) AS run)""")
def run_summary(t):
    """Two runs appended to one table of run records."""
    path, rows = t.scratch("runs"), t.labels.agg(F.count(F.lit(1))).scalar()
    for run in ("first", "second"):
        row = ev.run_record(scored_labels(t), rows, target="quality", parameters={"threshold": 0.5}, importances={"score": 1.0}, run_seconds=0.1,
                            analysis=["first line", "second line"], run=run, model_type="scored labels", file_name="labels", col_count=len(t.labels.columns))
        row = row.drop("tp", "fp", "fn", "tn").withColumns({c: F.round(c, 6) for c in ("log_loss", "log_loss_hard")})
        row.write.mode("append").parquet(path)
    kept = t.spark.read.schema(row.schema).parquet(path)
    recent = F.col("created_at").between(F.current_timestamp() - F.expr("interval 1 hour"), F.current_timestamp() + F.expr("interval 1 hour"))
    return kept.withColumns({"stamped": recent, "timed": F.col("run_seconds") > 0}).drop("created_at", "run_seconds")


TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents"


def _terms(t):
    # letters and digits of every script, at least two in a row
    return F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


@job("m14_bag_of_words", f"SELECT doc_id, term, count(*) AS n FROM ({TERMS}) GROUP BY ALL")
def bag_of_words(t):
    return t.documents.select("doc_id", F.explode(_terms(t)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@job("m14_vocabulary", f"""
    SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs, row_number() OVER (ORDER BY term) - 1 AS index FROM ({TERMS}) GROUP BY 1""")
def vocabulary(t):
    # per document first: the second grouping then counts documents without a distinct
    per_doc = bag_of_words(t)
    words = per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    return positions(stage(words, "vocabulary"), [F.col("term")], on="term").select("term", "n", "n_docs", (F.col("pos") - 1).alias("index"))


@job("m14_document_length", f"""
    SELECT d.doc_id, count(term) AS n_terms, count(DISTINCT term) AS n_distinct FROM documents d LEFT JOIN ({TERMS}) t ON t.doc_id = d.doc_id GROUP BY 1""")
def document_length(t):
    terms = _terms(t)
    return t.documents.select("doc_id", F.size(terms).cast("bigint").alias("n_terms"), F.size(F.array_distinct(terms)).cast("bigint").alias("n_distinct"))
