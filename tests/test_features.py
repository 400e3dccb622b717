from __future__ import annotations

import datetime as dt
import math
import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from lakepipe.features.boosting import Settings as Boosting
from lakepipe.features.boosting import boost
from lakepipe.features.encoding import CategoryIndex, Scaler, learn_categories, one_hot
from lakepipe.features.ensembles import Ensemble, of_pipeline, quoted
from lakepipe.features.evaluation import (
    area_under_roc,
    binary_metrics,
    confusion_matrix,
    log_loss,
    pr_points,
    roc_points,
    slice_accuracy,
    slice_gate,
    validation_report,
)
from lakepipe.features.scoring import (
    map_frames,
    model_udf,
    model_udf_of_columns,
    register_model,
    rule_model,
    score_table,
)
from lakepipe.features.tables import (
    assert_primary_key,
    assign_split,
    select_signature,
    split_by,
    write_feature_table,
)
from lakepipe.features.timestamps import timestamp_features
from lakepipe.features.training import predict, search, train


def test_one_hot_like_dummies(spark):
    pdf = pd.DataFrame({"id": [1, 2, 3], "c": ["x", "y", None]})
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, c string")
    found = one_hot(df, learn_categories(df, ["c"]))
    wanted = pd.get_dummies(pdf, columns=["c"], dtype="int64")
    assert found.columns == list(wanted.columns)
    assert rows(found) == sorted(tuple(r) for r in wanted.itertuples(index=False))


def test_one_hot_options_and_limit(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "c string")
    assert one_hot(df, {"c": ["x", "y"]}, drop_first=True).columns == ["c_y"]
    assert rows(one_hot(df, {"c": ["x"]}, unknown="other")) == [(0, 1), (0, 1), (0, 1), (1, 0)]
    with pytest.raises(ValueError, match="too many"):
        learn_categories(spark.range(500).withColumn("c", F.col("id").cast("string")), ["c"], limit=50)


def test_scaler_against_filled_column(spark):
    values = [1.0, 2.0, None, 5.0, None, 8.0]
    df = spark.createDataFrame([(v, 3.0) for v in values], "v double, flat double")
    filled = pd.Series(values).fillna(pd.Series(values).mean())
    wanted = (filled - filled.mean()) / filled.std(ddof=0)
    found = [r["v"] for r in Scaler.fit(df, ["v"]).transform(df).collect()]
    assert found == pytest.approx(list(wanted))
    assert {r["flat"] for r in Scaler.fit(df, ["flat"]).transform(df).collect()} == {0.0}


def test_timestamp_features(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 28, 6, 30),)], "t timestamp")
    holidays = spark.createDataFrame([(dt.date(2024, 12, 28),), (dt.date(2024, 12, 28),)], "holiday date")
    r = timestamp_features(df, "t", holidays).collect()
    assert len(r) == 1
    r = r[0]
    assert r["t_weekend"] == 1 and r["t_holiday"] == 1 and r["t_hour_6"] == 1 and r["t_hour_7"] == 0
    assert r["t_day_sin"] == pytest.approx(1.0) and r["t_day_cos"] == pytest.approx(0.0, abs=1e-12)
    assert r["t_month_cos"] == pytest.approx(math.cos(2 * math.pi * (27 * 24 + 6) / (31 * 24)))
    assert r["t_year_sin"] == pytest.approx(math.sin(2 * math.pi * (362 * 24 + 6) / (366 * 24)))
    assert "t_hour_3" not in timestamp_features(df, "t", hours=False).columns


def test_primary_key(spark):
    good = spark.createDataFrame([(1, "a"), (1, "b")], "k int, s string")
    assert_primary_key(good, ["k", "s"])
    for bad in (good.select("k"), good.withColumn("k", F.when(F.col("s") == "a", 1))):
        with pytest.raises(ValueError, match="primary key"):
            assert_primary_key(bad, ["k"])
    write_feature_table(good, "features_test", ["k", "s"])
    assert spark.table("features_test").count() == 2
    spark.sql("DROP TABLE features_test")


def test_signature(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    picked = select_signature(df, "c float, a bigint")
    assert picked.dtypes == [("c", "float"), ("a", "bigint")]
    with pytest.raises(ValueError, match="missing_column"):
        select_signature(df, "missing_column int")


def test_split_shares(spark):
    counts = {r["split"]: r["count"] for r in assign_split(spark.range(5000), "id").groupBy("split").count().collect()}
    assert abs(counts["train"] - 3000) < 200 and abs(counts["test"] - 1000) < 150
    exact = spark.range(100).select(split_by(F.col("id")).alias("s")).groupBy("s").count()
    assert rows(exact) == [("test", 20), ("train", 60), ("validate", 20)]


SIGNATURE = "n int, c string"
MODEL = rule_model(lambda f: [f["n"] > 2, f["c"] == "bad"], 1, 0)


def test_scoring_ways_agree(spark):
    df = spark.createDataFrame([(1, "ok"), (5, "ok"), (2, "bad"), (None, None)], "n int, c string")
    wanted = [(None, 0), (1, 0), (2, 1), (5, 1)]
    udf = model_udf(MODEL, SIGNATURE, "int")
    assert rows(score_table(df, udf, SIGNATURE), "n", "prediction") == wanted
    by_columns = model_udf_of_columns(MODEL, SIGNATURE, "int")
    assert rows(df.withColumn("prediction", by_columns("n", "c")), "n", "prediction") == wanted
    register_model(spark, "judge", udf)
    df.createOrReplaceTempView("to_judge")
    assert rows(spark.sql("SELECT n, judge(struct(c, n)) AS prediction FROM to_judge")) == wanted


def test_map_frames(spark):
    found = map_frames(spark.range(10), lambda f: f[f["id"] > 7].assign(d=1.5), "id long, d double")
    assert rows(found) == [(8, 1.5), (9, 1.5)]


def scored_rows(seed=1, n=400):
    draw = random.Random(seed)
    return [(draw.choice("ab"), int(draw.random() < 0.4), int(draw.random() < 0.5), draw.randrange(60)) for _ in range(n)]


def test_curves_against_brute_force(spark):
    data = scored_rows()
    df = spark.createDataFrame(data, "s string, label int, prediction int, score int")
    positives = sum(r[1] for r in data)
    negatives = len(data) - positives
    roc, pr = [], []
    for threshold in sorted({r[3] for r in data}):
        tp = sum(1 for r in data if r[3] >= threshold and r[1])
        fp = sum(1 for r in data if r[3] >= threshold and not r[1])
        roc.append((threshold, fp / negatives, tp / positives))
        pr.append((threshold, tp / (tp + fp), tp / positives))
    assert rows(roc_points(df, "label", "score")) == roc
    assert rows(pr_points(df, "label", "score")) == pr
    wins = sum(
        1.0 if p[3] > q[3] else 0.5 if p[3] == q[3] else 0.0
        for p in data if p[1] for q in data if not q[1]
    )
    assert area_under_roc(df, "label", "score").first()[0] == pytest.approx(wins / positives / negatives)


def test_curves_without_positives(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.7)], "label int, score double")
    assert [r["tpr"] for r in roc_points(df, "label", "score").collect()] == [None, None]


def test_metrics_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "label int, prediction int")
    assert rows(confusion_matrix(df, "label", "prediction")) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 2)]
    r = binary_metrics(df, "label", "prediction").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 1)
    assert r["precision"] == pytest.approx(2 / 3) and r["f1"] == pytest.approx(2 / 3)
    assert binary_metrics(df.limit(0), "label", "prediction").first()["precision"] is None


def slices(spark, good: int, bad: int):
    data = [("edge", 1, 1)] * good + [("edge", 1, 0)] * bad + [("fine", 1, 1)]
    return spark.createDataFrame(data, "s string, label int, prediction int")


def test_slice_gate_is_strict(spark):
    exact = slices(spark, 11, 9)
    assert rows(slice_accuracy(exact, ["s"], "label", "prediction"), "s", "accuracy") == [("edge", 0.55), ("fine", 1.0)]
    assert slice_gate(exact, ["s"], "label", "prediction").first()["passed"] is False
    assert slice_gate(slices(spark, 12, 8), ["s"], "label", "prediction").first()["passed"] is True
    assert slice_gate(exact.limit(0), ["s"], "label", "prediction").first()["passed"] is False


def test_validation_report(spark):
    def decide(df, inputs=("s",), text="a long enough description"):
        return validation_report(df, ["s"], "label", "prediction", inputs, text).first()

    good = slices(spark, 12, 8)
    assert decide(good)["decision"] == "accept"
    assert decide(slices(spark, 1, 9))["slices_passed"] is False
    assert decide(good, inputs=("missing",))["decision"] == "reject"
    assert decide(good, text="short")["has_description"] is False
    assert decide(good.withColumn("prediction", F.lit(None).cast("int")))["predicts"] is False


def test_training_learns_a_simple_rule(spark):
    data = [(i, float(i % 10), "u" if i % 2 else "v", int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(data, "id int, x double, c string, label int")
    model = train(df, "label", ["x"], ["c"], trees=3, depth=2)
    scored = predict(model, df, ["id", "label"])
    assert scored.filter("label = prediction").count() == 200
    unseen = spark.createDataFrame([(1, 9.0, "new", 1), (2, None, "u", 0)], "id int, x double, c string, label int")
    assert predict(model, unseen, ["id"]).count() == 2
    best = search(df, "label", ["x"], {"maxDepth": [1, 2], "maxIter": [2]}).bestModel
    assert predict(best, df, ["id", "label"]).filter("label = prediction").count() == 200


def test_churn_chance_counts_signs(spark):
    from lakepipe.plans.retail import CHANCE_PER_SIGN, LEAST_CHANCE, with_churn_chance

    columns = (
        "days_since_last_activity int, total_amount double, event_count int, session_count int, order_count int, "
        "total_item int"
    )
    data = [(10, 9e6, 40, 4, 20, 90), (900, 10.0, 1, 4, 2, 2), (None, 10.0, None, 4, 20, 90)]
    found = with_churn_chance(spark.createDataFrame(data, columns))
    chances = [(n, LEAST_CHANCE + CHANCE_PER_SIGN * n) for n in (0, 5, 1)]
    assert [(r["matched_rules"], r["churn_chance"]) for r in found.collect()] == chances


def test_models_run_where_the_package_is_not_installed(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lakepipe.plans.turbines import _faulty

    packed = tmp_path / "model.pkl"
    packed.write_bytes(cloudpickle.dumps(rule_model(_faulty, "bad", "ok")))
    code = (
        "import pickle, sys, pandas as pd; f = pickle.load(open(sys.argv[1], 'rb'));"
        "print(list(f(pd.DataFrame({'avg_energy': [1.0], 'std_sensor_A': [1.0], 'state': ['x']}))))"
    )
    done = subprocess.run(
        [sys.executable, "-c", code, str(packed)], capture_output=True, text=True, cwd=tmp_path, timeout=60
    )
    assert done.stdout.strip() == "['bad']", done.stderr


# --- ensembles as expressions, boosting, category index ----------------------------


def messy(spark, n=600):
    draw = random.Random(4)
    data = []
    for i in range(n):
        x, y = draw.uniform(-3, 3), draw.choice([None, float("nan"), *range(5)])
        c = draw.choice(["u", "it's", "back\\slash", None, "w"])
        kind = (0 if x < -1 else 1 if x * x < 0.5 else 2) if draw.random() < 0.9 else draw.randrange(3)
        data.append((i, x, None if y is None else float(y), 7.0, c, int((x > 0) != (c == "u")), kind))
    return spark.createDataFrame(data, "id int, x double, `y y` double, same double, c string, label int, kind int")


@pytest.mark.parametrize("classes", [2, 3])
def test_compiled_ensemble_equals_the_model(spark, tmp_path, classes):
    df = messy(spark)
    label = "label" if classes == 2 else "kind"
    fitted = train(df, label, ["x", "y y", "same"], ["c"], classes=classes, trees=6, depth=4)
    model = of_pipeline(fitted)
    model.save(spark, str(tmp_path / "model"))
    again = Ensemble.load(spark, str(tmp_path / "model"))
    assert again == model
    unseen = spark.createDataFrame([(9999, None, float("inf"), 8.0, "new", 0, 0), (9998, -0.0, -1e300, None, None, 1, 1)], df.schema)
    both = df.unionByName(unseen)
    theirs = fitted.transform(both.withColumn("p", again.probability_column()))
    chance = vector_to_array("probability")
    far = F.exists(F.zip_with("p", chance, lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)
    assert theirs.where(far | far.isNull()).count() == 0
    ours = again.score(both).select("id", F.col("prediction").alias("own"), F.col("probability").alias("own_p"))
    joined = ours.join(theirs, "id")
    assert joined.where("own != prediction").where(F.abs(F.array_max(chance) - F.array_sort(chance)[classes - 2]) > 1e-9).count() == 0
    model.register(spark, f"own_model_{classes}", {f.name: f.dataType.simpleString() for f in df.schema.fields})
    both.createOrReplaceTempView("both_rows")
    called = ", ".join(quoted(c) for c in model.columns)
    by_name = spark.sql(f"SELECT id, own_model_{classes}({called}) AS q FROM both_rows").join(theirs.select("id", "p"), "id")
    assert by_name.where("q != p OR q IS NULL").count() == 0


def test_boosting_beats_the_forest_on_held_out_rows(spark):
    df = assign_split(messy(spark, 1500), "id")
    learned, held = df.where("split = 'train'"), df.where("split != 'train'")
    model = boost(learned, "kind", ["x", "y y", "same"], 3, Boosting(rounds=12, depth=3))
    forest = train(learned, "kind", ["x", "y y", "same"], classes=3, trees=12, depth=3)
    scored = held.withColumn("p", model.probability_column())
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    assert scored.where(F.abs(total - 1) > 1e-12).count() == 0
    ours = log_loss(scored, "kind", "p").first()[0]
    theirs = log_loss(forest.transform(held).withColumn("p", vector_to_array("probability")), "kind", "p").first()[0]
    assert ours < theirs < math.log(3)


def own_boost(data, classes, rounds, rate, ridge, edges):
    """One split a tree, by trying every edge."""
    labels, xs = [r[1] for r in data], [r[0] for r in data]
    margins = [[math.log(labels.count(k) / len(labels)) for k in range(classes)] for _ in data]
    for _ in range(rounds):
        chances = [[math.exp(m - max(row)) for m in row] for row in margins]
        chances = [[c / sum(row) for c in row] for row in chances]
        steps = []
        for k in range(classes):
            g = [p[k] - (y == k) for p, y in zip(chances, labels)]
            h = [p[k] * (1 - p[k]) for p in chances]

            def gain(on):
                return sum(g[i] for i in on) ** 2 / (sum(h[i] for i in on) + ridge)

            def leaf(on):
                return -rate * (classes - 1) / classes * sum(g[i] for i in on) / (sum(h[i] for i in on) + ridge)

            every = range(len(data))
            sides = [([i for i in every if xs[i] <= e], [i for i in every if not xs[i] <= e]) for e in edges]
            low, high = max((s for s in sides if s[0] and s[1]), key=lambda s: gain(s[0]) + gain(s[1]))
            steps.append({i: leaf(on) for on in (low, high) for i in on})
        margins = [[m + steps[k][i] for k, m in enumerate(row)] for i, row in enumerate(margins)]
    return [[math.exp(m) / sum(map(math.exp, row)) for m in row] for row in margins]


def test_boosting_by_hand(spark):
    draw = random.Random(6)
    data = [(float(draw.randrange(12)), draw.choices([0, 1, 2], [i % 3 + 1, 2, 1])[0]) for i in range(90)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, x double, label int")
    settings = Boosting(rounds=4, depth=1, bins=64, rate=0.5, ridge=0.7, keep_every=2)
    noise = spark.createDataFrame([(1000, 3.0, None), (1001, 3.0, 7)], df.schema)
    model = boost(df.unionByName(noise), "label", ["x"], 3, settings)
    found = {r["id"]: r["p"] for r in df.select("id", model.probability_column().alias("p")).collect()}
    expected = own_boost(data, 3, 4, 0.5, 0.7, sorted({r[0] for r in data}))
    for i, row in enumerate(expected):
        assert found[i] == pytest.approx(row, abs=1e-9)
    with pytest.raises(ValueError, match="no row"):
        boost(df.limit(0), "label", ["x"], 3, settings)


def test_category_index_equals_the_collecting_encoder(spark):
    df = messy(spark)
    index = CategoryIndex.fit(df.where("c != 'w' OR c IS NULL"), ["c", "label"])
    assert index.sizes == {"c": 3, "label": 2}
    # w was not learned: the place behind c's values
    numbers = {r["c"]: r["c_index"] for r in index.index(df).collect()}
    assert numbers == {"back\\slash": 0, "it's": 1, "u": 2, "w": 3, None: None}
    vectors = index.transform(df).select("c", "label", "features").collect()
    assert len(vectors) == df.count()
    for r in vectors:
        wanted = ([] if r["c"] is None else [numbers[r["c"]]]) + [4 + r["label"]]
        assert isinstance(r["features"], SparseVector) and r["features"].size == 7
        assert list(r["features"].indices) == wanted and set(r["features"].values) == {1.0}
    empty = CategoryIndex.fit(df.limit(0), ["c"])
    assert empty.sizes == {"c": 0} and empty.index(df).where("c IS NOT NULL AND c_index != 0").count() == 0


def test_a_million_categories_stay_on_the_executors(spark, monkeypatch):
    n = 1_000_000
    df = spark.range(n, numPartitions=4).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    rows_taken = []
    plain = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: rows_taken.append(plain(self)) or rows_taken[-1])
    index = CategoryIndex.fit(df, ["c"])
    encoded = index.index(df).agg(F.count_distinct("c_index").alias("n"), F.max("c_index").alias("top"))
    first = encoded.first()
    assert (first["n"], first["top"]) == (n, n - 1)
    assert max(map(len, rows_taken)) < 10
    with pytest.raises(ValueError, match="too many categories"):
        learn_categories(df, ["c"])
    with pytest.raises(ValueError, match="too many categories"):
        train(df.withColumns({"x": F.lit(1.0), "label": F.lit(1)}), "label", ["x"], ["c"])


def test_curves_by_group_equal_curves_of_the_group(spark):
    draw = random.Random(9)
    data = [(draw.choice(["a", "b", None]), draw.randrange(2), draw.randrange(20) / 20) for _ in range(400)]
    df = spark.createDataFrame(data, "part string, label int, score double")
    for curve in (roc_points, pr_points, area_under_roc):
        whole = curve(df, "label", "score", by=["part"])
        for part in ("a", "b", None):
            own = curve(df.where(F.col("part").eqNullSafe(F.lit(part))), "label", "score")
            assert rows(whole.where(F.col("part").eqNullSafe(F.lit(part))).drop("part")) == rows(own)
