"""Feature tables, training, evaluation and release checks."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.features.boosting import Settings as Boosting
from lakepipe.features.boosting import boost
from lakepipe.features.encoding import CategoryIndex, Scaler, learn_categories, one_hot
from lakepipe.features.ensembles import Ensemble, of_pipeline, quoted
from lakepipe.features.evaluation import (
    area_under_roc,
    binary_metrics,
    confusion_matrix,
    pr_points,
    roc_points,
    slice_accuracy,
    slice_gate,
    validation_report,
)
from lakepipe.features.tables import assign_split, primary_key_report
from lakepipe.features.timestamps import timestamp_features
from lakepipe.features.training import predict, search, train
from lakepipe.functions.naming import clean_dummy_names
from lakepipe.functions.scalars import map_values
from lakepipe.plans.registry import query, rounded, table
from lakepipe.plans.retail import CHURN_VIEWS, churn_features_of
from lakepipe.plans.views import TELCO_FLAGS, scored, telco, with_views
from lakepipe.session import scratch_path, written

CATEGORICAL = [
    "contract",
    "gender",
    "internet_service",
    "payment_method",
    *[column for column, *_ in TELCO_FLAGS],
]
# Fixed value: the label mapping.
YES_NO = {"Yes": 1, "No": 0}


def _hot(column: str, value: str, name: str) -> str:
    return f"CAST(coalesce({column} = '{value}', false) AS BIGINT) AS {name}"


_ONE_HOT_SQL = ", ".join(
    _hot("c_mktsegment", v, f'"c_mktsegment_{v}"')
    for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
)


@query("one_hot", f"SELECT c_custkey, {_ONE_HOT_SQL} FROM customer")
def one_hot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return one_hot(customers, learn_categories(customers, ["c_mktsegment"]))


_DUMMIES = {
    "contract": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "gender": ["Female", "Male"],
    "internet_service": ["DSL", "Fiber optic", "No"],
    "payment_method": [
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ],
    **{column: list(values) for column, values, _ in TELCO_FLAGS},
}


def _dummy_name(column: str, value: str) -> str:
    text = f"{column}_{value}".lower()
    return "".join("_" if ch in "() -" else ch for ch in text)


_DUMMY_SQL = ", ".join(_hot(c, v, _dummy_name(c, v)) for c, values in _DUMMIES.items() for v in values)


def telco_features(raw: DataFrame) -> DataFrame:
    """Indicators for the categories, 0/1 label, clean names, complete rows only."""
    encoded = one_hot(raw, learn_categories(raw, CATEGORICAL))
    labelled = encoded.withColumn("churn", map_values("churn", YES_NO))
    return clean_dummy_names(labelled).dropna("any")


@query(
    "churn_onehot_features",
    with_views(
        f"""SELECT customer_id, tenure, monthly_charges, CASE churn WHEN 'Yes' THEN 1 ELSE 0 END AS churn, {_DUMMY_SQL}
            FROM telco WHERE monthly_charges IS NOT NULL AND churn IS NOT NULL""",
        "telco",
    ),
)
def churn_onehot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telco_features(telco(spark, sf_dir))


@query(
    "map_label",
    with_views(
        "SELECT customer_id, CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn FROM telco", "telco"
    ),
)
def map_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telco(spark, sf_dir).select("customer_id", map_values("churn", YES_NO).alias("churn"))


@query(
    "feature_pk_check",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count,
              CAST(coalesce(sum(n) FILTER (o_custkey IS NULL OR o_orderstatus IS NULL), 0) AS BIGINT) AS null_key_rows,
              count(*) FILTER (o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND n > 1) AS duplicate_keys
       FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM
               (SELECT o_custkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders)
             GROUP BY ALL)""",
)
def feature_pk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderstatus")).alias("o_orderstatus")
    )
    return primary_key_report(orders, ["o_custkey", "o_orderstatus"])


_SCALED = ["tenure", "monthly_charges"]


@query(
    "impute_standardize",
    with_views(
        """, m AS (SELECT avg(tenure) AS mt, stddev_pop(tenure) AS st, avg(monthly_charges) AS mm,
                     sqrt(var_pop(monthly_charges) * count(monthly_charges) / count(*)) AS sm FROM telco)
           SELECT customer_id, round((tenure - mt) / st, 6) AS tenure,
                  round((coalesce(monthly_charges, mm) - mm) / sm, 6) AS monthly_charges FROM telco, m""",
        "telco",
    ),
)
def impute_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = telco(spark, sf_dir).select("customer_id", *_SCALED)
    scaled = Scaler.fit(raw, _SCALED).transform(raw)
    return scaled.withColumns({c: rounded(F.col(c) + 0.0) for c in _SCALED})


_HOURS_SQL = ", ".join(f"CAST(hour(ts) = {h} AS INTEGER) AS ts_hour_{h}" for h in range(24))


def _circle_sql(name: str, position: str) -> str:
    return ", ".join(f"round({f}(2 * pi() * {position}), 6) AS ts_{name}_{f}" for f in ("sin", "cos"))


_CYCLES_SQL = ", ".join(
    [
        _circle_sql("day", "hour(ts) / 24.0::DOUBLE"),
        _circle_sql("week", "((isodow(ts) - 1) * 24 + hour(ts)) / 168.0::DOUBLE"),
        _circle_sql("month", "((day(ts) - 1) * 24 + hour(ts)) / (day(last_day(ts)) * 24.0::DOUBLE)"),
        _circle_sql(
            "year",
            "((dayofyear(ts) - 1) * 24 + hour(ts)) / (24.0::DOUBLE * "
            "date_diff('day', date_trunc('year', ts), date_trunc('year', ts) + INTERVAL 1 YEAR))",
        ),
    ]
)


@query(
    "timestamp_features",
    f"""SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS ts_unix,
               CAST(isodow(ts) >= 6 AS INTEGER) AS ts_weekend, {_HOURS_SQL}, {_CYCLES_SQL},
               CAST(CAST(ts AS DATE) IN (SELECT DISTINCT CAST(date_trunc('week', e.ts) AS DATE) FROM events e)
                    AS INTEGER) AS ts_holiday
        FROM events""",
)
def event_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of the holiday flag is a table input; here every Monday is one."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    calendar = events.select(F.to_date(F.date_trunc("week", "ts")).alias("holiday"))
    features = timestamp_features(events, "ts", calendar)
    cyclic = [c for c in features.columns if c.endswith(("_sin", "_cos"))]
    return features.withColumns({c: rounded(c) for c in cyclic})


@query(
    "split_assign",
    """SELECT doc_id, CASE WHEN p < 60 THEN 'train' WHEN p < 80 THEN 'validate' ELSE 'test' END AS split
       FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS p FROM documents)""",
)
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "slice_accuracy",
    with_views(
        """SELECT lang, source, CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct,
                  count(*) AS observations,
                  sum(CASE WHEN label = prediction THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
           FROM scored GROUP BY lang, source""",
        "scored",
    ),
)
def accuracy_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_accuracy(scored(spark, sf_dir), ["lang", "source"], "label", "prediction")


_SLICES_SQL = """, slices AS (
  SELECT lang, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) > 0.55 AS ok FROM scored GROUP BY lang)
"""


@query(
    "slice_gate",
    with_views(
        _SLICES_SQL + "SELECT count(*) AS slices, count(*) FILTER (ok) AS passed_slices, bool_and(ok) AS passed FROM slices",
        "scored",
    ),
)
def gate_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_gate(scored(spark, sf_dir), ["lang"], "label", "prediction")


@query(
    "validation_report",
    with_views(
        _SLICES_SQL
        + """SELECT (SELECT count(*) FILTER (prediction IS NULL) = 0 FROM scored) AS predicts,
                    bool_and(ok) AS slices_passed, true AS has_signature, true AS has_description,
                    CASE WHEN bool_and(ok) AND (SELECT count(*) FILTER (prediction IS NULL) = 0 FROM scored)
                         THEN 'accept' ELSE 'reject' END AS decision FROM slices""",
        "scored",
    ),
)
def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_report(
        scored(spark, sf_dir),
        ["lang"],
        "label",
        "prediction",
        expected_inputs=["score", "lang", "source"],
        description="Flags documents of low quality by their length.",
    )


@query(
    "confusion_matrix",
    with_views("SELECT label, prediction, count(*) AS rows FROM scored GROUP BY label, prediction", "scored"),
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_matrix(scored(spark, sf_dir), "label", "prediction")


@query(
    "binary_metrics",
    with_views(
        """SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy,
                  round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall,
                  round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1
           FROM (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
                        count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                        count(*) FILTER (label = 1 AND prediction = 0) AS fn,
                        count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM scored)""",
        "scored",
    ),
)
def metrics_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = binary_metrics(scored(spark, sf_dir), "label", "prediction")
    return row.withColumns({c: rounded(c) for c in ("accuracy", "precision", "recall", "f1")})


_CURVE_SQL = """, s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
                        FROM scored GROUP BY score),
  c AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
               (SELECT sum(pos) FROM s) AS p, (SELECT sum(neg) FROM s) AS n
        FROM s WINDOW w AS (ORDER BY score DESC))
"""


@query(
    "roc_points",
    with_views(
        _CURVE_SQL + "SELECT threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM c",
        "scored",
    ),
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = roc_points(scored(spark, sf_dir), "label", "score")
    return points.withColumns({c: rounded(c) for c in ("fpr", "tpr")})


@query(
    "pr_points",
    with_views(
        _CURVE_SQL
        + "SELECT threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall FROM c",
        "scored",
    ),
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pr_points(scored(spark, sf_dir), "label", "score")
    return points.withColumns({c: rounded(c) for c in ("precision", "recall")})


@query(
    "area_under_roc",
    with_views(
        _CURVE_SQL
        + "SELECT round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(p::DOUBLE * n), 6) AS area_under_roc FROM c",
        "scored",
    ),
)
def roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_under_roc(scored(spark, sf_dir), "label", "score").withColumn(
        "area_under_roc", rounded("area_under_roc")
    )


NUMERIC = ["order_count", "total_amount", "event_count", "session_count", "age_group", "days_since_creation"]


def _split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: the learners pass over the features many times."""
    features = churn_features_of(spark, sf_dir).select("user_id", "churn", *NUMERIC, "country", "platform")
    return written(assign_split(features, "user_id"), "features")


@query("train_score_gbt")
def train_score_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the churn features; every user is scored with the fitted model."""
    features = _split_features(spark, sf_dir)
    model = train(features.filter("split = 'train'"), "churn", NUMERIC, ["country", "platform"])
    return predict(model, features, ["user_id", "split", "churn"])


_EVENT_KINDS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def _kind_model(spark: SparkSession, sf_dir: str) -> tuple[Ensemble, DataFrame]:
    """Boosted trees that tell which kind of event a reading belongs to, and the readings with their split."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        F.hour("ts").alias("hour"),
        F.dayofweek("ts").alias("weekday"),
        map_values("event_type", _EVENT_KINDS).alias("kind"),
    )
    split = written(assign_split(events, "event_id"), "kinds")
    inputs = ["value", "hour", "weekday"]
    return boost(split.filter("split = 'train'"), "kind", inputs, len(_EVENT_KINDS), Boosting(rounds=10)), split


@query("train_score_multiclass")
def train_score_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading with the kind that the boosted trees give it; the model is a column expression."""
    model, events = _kind_model(spark, sf_dir)
    return model.score(events).select("event_id", "split", "kind", "prediction", "probability")


@query(
    "multiclass_recount",
    """SELECT split, kind, count(*) AS rows, true AS sums_to_one, true AS known_class, true AS as_good_as_shares
       FROM (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                                    WHEN 'signup' THEN 3 ELSE 4 END AS kind,
                    CASE WHEN p < 60 THEN 'train' WHEN p < 80 THEN 'validate' ELSE 'test' END AS split
             FROM (SELECT *, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS p FROM events))
       GROUP BY split, kind""",
)
def multiclass_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored readings counted again: none is lost, probabilities add up, training lowers the loss of the class shares."""
    model, events = _kind_model(spark, sf_dir)
    scored_events = events.withColumn("p", model.probability_column())
    shares = F.array(*[F.lit(share) for share in _softmax_of(model.bases)])
    loss = F.avg(F.when(F.col("split") == "train", -F.log(F.get("p", F.col("kind")))))
    plain = F.avg(F.when(F.col("split") == "train", -F.log(F.get(shares, F.col("kind")))))
    better = scored_events.agg((loss <= plain).alias("better")).first()["better"]
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    return scored_events.groupBy("split", "kind").agg(
        F.count(F.lit(1)).alias("rows"),
        F.every(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.every(F.array_position("p", F.array_max("p")).between(1, len(_EVENT_KINDS))).alias("known_class"),
        F.lit(better).alias("as_good_as_shares"),
    )


def _softmax_of(margins: tuple[float, ...]) -> list[float]:
    raised = [math.exp(m) for m in margins]
    return [r / sum(raised) for r in raised]


@query(
    "score_fitted_model",
    with_views(
        """SELECT user_id, CASE WHEN p < 60 THEN 'train' WHEN p < 80 THEN 'validate' ELSE 'test' END AS split,
                  true AS same_class, true AS same_probability, true AS same_by_name
           FROM (SELECT user_id, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS p FROM churn)""",
        *CHURN_VIEWS,
    ),
)
def score_fitted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model compiled to a column expression, called by name from SQL, its scores saved, against the model itself."""
    features = _split_features(spark, sf_dir)
    fitted = train(features.filter("split = 'train'"), "churn", NUMERIC, ["country", "platform"], trees=10, depth=4)
    model = of_pipeline(fitted)
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    model.register(spark, "churn_probability", kinds)
    called = ", ".join(quoted(c) for c in model.columns)
    by_name = features.selectExpr("*", f"churn_probability({called}) AS by_name")
    path = scratch_path(spark, "scored")
    model.score(by_name, "own_class", "own_probability").write.parquet(path)
    judged = fitted.transform(spark.read.parquet(path))
    chance = vector_to_array("probability")
    return judged.select(
        "user_id",
        "split",
        (F.col("own_class") == F.col("prediction").cast("int")).alias("same_class"),
        (F.abs(F.col("own_probability") - F.array_max(chance)) < 1e-9).alias("same_probability"),
        (F.abs(F.col("by_name")[1] - chance[1]) < 1e-9).alias("same_by_name"),
    )


_LINEAR_SQL = """, t AS (
  SELECT o_orderkey, o_totalprice AS x, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
         CASE WHEN p < 60 THEN 'train' WHEN p < 80 THEN 'validate' ELSE 'test' END AS split
  FROM (SELECT *, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS p FROM orders)),
m AS (SELECT avg(label) AS ml, avg(x) AS mx, covar_pop(label, x) / var_pop(x) AS slope FROM t WHERE split = 'train'),
g AS (SELECT split, label, round(ml + slope * (x - mx), 4) AS score FROM t, m),
s AS (SELECT split, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM g GROUP BY ALL),
c AS (SELECT split, score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER (PARTITION BY split) AS p, sum(neg) OVER (PARTITION BY split) AS n
      FROM s WINDOW w AS (PARTITION BY split ORDER BY score DESC))
"""


def _linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored by a line that is fitted to the training part."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )
    split = written(assign_split(orders, "o_orderkey"), "orders")
    fit = split.filter("split = 'train'").agg(
        F.avg("label").alias("ml"), F.avg("x").alias("mx"), (F.covar_pop("label", "x") / F.var_pop("x")).alias("slope")
    ).first()
    score = F.lit(fit["ml"]) + F.lit(fit["slope"]) * (F.col("x") - F.lit(fit["mx"]))
    return split.select("split", "label", rounded(score, 4).alias("score"))


@query(
    "roc_by_split",
    "WITH one AS (SELECT 1)"
    + _LINEAR_SQL
    + "SELECT split, threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM c",
)
def roc_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve each for training, validation and test part of a fitted model's scores."""
    points = roc_points(_linear_scores(spark, sf_dir), "label", "score", by=["split"])
    return points.withColumns({c: rounded(c) for c in ("fpr", "tpr")})


@query(
    "pr_by_split",
    "WITH one AS (SELECT 1)"
    + _LINEAR_SQL
    + "SELECT split, threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall FROM c",
)
def pr_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pr_points(_linear_scores(spark, sf_dir), "label", "score", by=["split"])
    return points.withColumns({c: rounded(c) for c in ("precision", "recall")})


@query("param_search")
def param_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of depths and numbers of trees; the best by F1 on a validation part scores the table."""
    features = _split_features(spark, sf_dir)
    best = search(features, "churn", NUMERIC, {"maxDepth": [3, 5], "maxIter": [5, 10]}).bestModel
    return predict(best, features, ["user_id", "churn"])


@query(
    "category_index",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name_index,
              CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_index,
              (SELECT count(DISTINCT c_name) + count(DISTINCT c_mktsegment) + 2 FROM customer)::INTEGER AS size,
              2 AS ones
       FROM customer""",
)
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns as indicators in sparse vectors, one of them with a value for every customer."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    index = CategoryIndex.fit(customers, ["c_name", "c_mktsegment"])
    vectors = index.transform(index.index(customers), "features")
    described = F.unwrap_udt("features")
    return vectors.select(
        "c_custkey",
        "c_name_index",
        "c_mktsegment_index",
        described["size"].alias("size"),
        F.size(described["indices"]).alias("ones"),
    )


@query(
    "one_hot_unknown",
    """SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS c_mktsegment_BUILDING,
              CAST(c_mktsegment = 'MACHINERY' AS BIGINT) AS c_mktsegment_MACHINERY,
              CAST(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS BIGINT) AS c_mktsegment_unknown FROM customer""",
)
def one_hot_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were not learned fall into one extra indicator."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return one_hot(customers, {"c_mktsegment": ["BUILDING", "MACHINERY"]}, unknown="unknown")


@query(
    "one_hot_drop_first",
    """SELECT c_custkey, CAST(c_acctbal < 0 AS BIGINT) AS negative_true FROM customer""",
)
def one_hot_drop_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") < 0).cast("string").alias("negative")
    )
    return one_hot(customers, learn_categories(customers, ["negative"]), drop_first=True)
