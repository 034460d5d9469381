"""Model invariants and metric operators against Spark's own evaluator."""

import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flagloom.operators import metrics, ml
from flagloom.plans import catalog
from flagloom.session import scratch_path


@pytest.fixture
def pred(spark):
    # class 3 is never predicted; class 4 is predicted but never a label
    rows = [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 2.0),
            (2.0, 4.0), (3.0, 0.0), (3.0, 1.0), (1.0, 0.0)]
    return spark.createDataFrame(rows, "label double, prediction double")


@pytest.mark.parametrize("metric,col", [("accuracy", "accuracy"), ("weightedPrecision", "weighted_precision"),
                                        ("weightedRecall", "weighted_recall"), ("f1", "weighted_f1")])
def test_metrics_equal_spark_evaluator(spark, pred, metric, col):
    ours = metrics.classification_metrics(pred).first()[col]
    ref = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                            metricName=metric).evaluate(pred)
    assert math.isclose(ours, ref, rel_tol=1e-12, abs_tol=1e-12)


def test_perfect_and_all_wrong(spark):
    perfect = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "label double, prediction double")
    wrong = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "label double, prediction double")
    assert tuple(metrics.classification_metrics(perfect).first()) == (1.0, 1.0, 1.0, 1.0)
    assert tuple(metrics.classification_metrics(wrong).first()) == (0.0, 0.0, 0.0, 0.0)


def test_class_report_rows(spark, pred):
    rep = {r["class"]: r for r in metrics.class_report(pred).collect()}
    assert set(rep) == {"0", "1", "2", "3", "4", "accuracy", "macro avg", "weighted avg"}
    assert rep["3"]["precision"] == 0.0 and rep["3"]["support"] == 2
    assert rep["4"]["support"] == 0 and rep["4"]["recall"] == 0.0
    assert math.isclose(rep["accuracy"]["f1"], 5 / 10)


def test_confusion_counts_total(spark, pred):
    assert metrics.confusion_counts(pred).agg(F.sum("n")).first()[0] == pred.count()
    m = metrics.confusion_matrix(pred, [0.0, 1.0])
    got = {r["label"]: tuple(r)[1:] for r in m.collect()}
    assert got == {0.0: (2, 1, 0), 1.0: (1, 2, 0), 2.0: (0, 0, 2), 3.0: (1, 1, 0)}


def test_class_names_of_non_integers(spark):
    df = spark.createDataFrame([(1.2, 1.7), (1.7, 1.7), (2.0, 2.0)], "label double, prediction double")
    names = {r["class"] for r in metrics.class_report(df).collect()}
    assert {"1.2", "1.7", "2"} <= names


def test_hash_split_is_layout_independent(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = ml.hash_split(df.repartition(1), "k").where("split = 'train'").count()
    b = ml.hash_split(df.repartition(7), "k").where("split = 'train'").count()
    assert a == b and 3800 < a < 4200
    fine = spark.range(100000).withColumnRenamed("id", "k")
    assert 200 < ml.hash_split(fine, "k", 0.995).where("split = 'test'").count() < 900


def test_kmeans_invariants(spark):
    e = ml.array_features(catalog.table(spark, SF_SMALL, "embeddings"), "embedding")
    model = ml.fit_kmeans(e, k=4, seed=42, key="vec_id", rows_per_partition=125)
    out = ml.assign_clusters(model, e)
    assert out.count() == e.count()
    ids = {r[0] for r in out.select("cluster").distinct().collect()}
    assert ids <= {0, 1, 2, 3}
    # every row sits at its nearest center
    near = catalog.QUERIES["kmeans_assign"](spark, SF_SMALL)
    assert near.count() == e.count() and near.where("NOT at_nearest_centre").count() == 0
    # same seed, same stated layout -> same centres under any session setting
    centers, before = model.clusterCenters(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "4", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            again = ml.fit_kmeans(e, k=4, seed=42, key="vec_id", rows_per_partition=125)
            assert all((a == b).all() for a, b in zip(centers, again.clusterCenters()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        ml.fit_kmeans(e, k=4, seed=42, key="vec_id")


def test_fit_tasks_follow_the_rows(spark):
    rows = spark.range(5000).selectExpr("id", "double(id % 7) x")
    assert ml.fit_partitions(rows, 500) == 10 and ml.fit_partitions(rows.limit(1), 500) == 1 == ml.fit_partitions(rows.limit(0), 500)
    data = ml._fit_input(rows, "id", 400)
    try:
        assert data.rdd.getNumPartitions() == 13 and data.count() == 5000
        assert "hashpartitioning(id" in data._jdf.queryExecution().executedPlan().toString()
    finally:
        data.unpersist()
    with pytest.raises(ValueError):
        ml.fit_partitions(rows, 0)


def test_learning_facts(spark):
    rows = spark.range(1000).selectExpr("double(id % 10 < 6) label", "id")
    facts = lambda df: metrics.learning_facts(df).first()
    right = facts(rows.withColumn("prediction", F.col("label")))
    assert tuple(right)[:3] == (1000, 1.0, 0.6) and right["accuracy"] > right["largest_share"] + right["margin"]
    for constant in (0.0, 1.0, None):
        got = facts(rows.withColumn("prediction", F.lit(constant).cast("double")))
        assert not got["accuracy"] > got["largest_share"] + got["margin"]
    empty = facts(rows.limit(0).withColumn("prediction", F.col("label")))
    assert empty["accuracy"] == 0 and empty["rows"] is None


@pytest.mark.parametrize("name", ["rf_cluster_label", "rf_fit_all", "rf_binary"])
def test_a_constant_prediction_is_no_learning(spark, monkeypatch, name):
    """The rows' facts hold for the fitted forest and fail where every prediction is the same."""
    assert catalog.QUERIES[name](spark, SF_SMALL).where("NOT (known_class AND learned AND chance_without_labels)").isEmpty()

    class Constant:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(ml, "fit_forest", lambda *a, **k: Constant())
    monkeypatch.setattr(ml, "fit_forest_pipeline", lambda *a, **k: Constant())
    assert catalog.QUERIES[name](spark, SF_SMALL).where("learned").isEmpty()


def test_redrawn_labels_keep_their_shares_only(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 4 = 0 then 1.0D when id % 40 = 1 then null else 0.0D end label")
    out = ml.redraw_labels(df, "label", "id", 7)
    assert out.columns == df.columns and out.count() == 20_000
    share = {r["label"]: r["count"] / 20_000 for r in out.groupBy("label").count().collect()}
    assert abs(share[1.0] - 0.25) < 0.02 and abs(share[None] - 0.025) < 0.01
    both = out.join(df.withColumnRenamed("label", "old"), "id").where("label = 1 AND old = 1").count() / 20_000
    assert abs(both - 0.0625) < 0.01
    assert out.repartition(7).exceptAll(ml.redraw_labels(df.repartition(3), "label", "id", 7)).isEmpty()


def test_sparse_features_of_two_thousand_countries(spark):
    df = spark.range(3000).selectExpr(
        "id", "case when id % 50 = 0 then null else array(concat('c', id % 2000), concat('c', (id * 7) % 2000), 'everywhere') end countries",
        "array(concat('g', id % 9)) genres", "double(id % 5) size")
    sources = {"genre": "genres", "country": "countries"}
    words = ml.token_dictionary(df, sources, scratch_path(spark, "dictionary"))
    names = sorted({("genre", f"g{i}") for i in range(9)} | {("country", "everywhere")}
                   | {("country", f"c{x}") for i in range(3000) if i % 50 for x in (i % 2000, i * 7 % 2000)})
    assert sorted((r["index"], r["source"], r["token"]) for r in words.collect()) == [(n, *t) for n, t in enumerate(names)]
    path = scratch_path(spark, "sparse")
    vectors = ml.sparse_features(df, "id", sources, words, path)
    place = {t: n for n, t in enumerate(names)}
    got = {r["id"]: r["features"] for r in vectors.collect()}
    assert len(got) == 3000 and len(vectors.columns) == 2
    for i, v in got.items():
        want = {("genre", f"g{i % 9}")}
        if i % 50:
            want |= {("country", "everywhere"), ("country", f"c{i % 2000}"), ("country", f"c{i * 7 % 2000}")}
        assert v.size == len(names) and sorted(v.indices.tolist()) == sorted(place[t] for t in want) and set(v.values.tolist()) == {1.0}
    pairs = ml.sparse_pairs(spark, path, "id")
    assert pairs.columns == ["id", "index", "value"] and pairs.count() == sum(len(v.indices) for v in got.values())
    x = ml.assemble(vectors.join(df.select("id", "size"), "id"), ["size", "features"], "all")
    model = ml.fit_kmeans(x, k=3, seed=1, features="all", key="id", rows_per_partition=1000)
    assert ml.assign_clusters(model, x.withColumnRenamed("all", "all")).count() == 3000 and len(model.clusterCenters()[0]) == len(names) + 1
    none = ml.sparse_features(df.limit(0), "id", sources, words, scratch_path(spark, "sparse"))
    assert none.count() == 0


def test_forest_importances_and_predictions(spark):
    train, _ = ml.split_frames(catalog._clustered(spark, SF_SMALL, 4), "p_partkey", 0.8, 42)
    model = catalog._forest_pipeline(train)
    vals = [r["importance"] for r in ml.feature_importances(spark, model, catalog.MODEL_FEATURES).collect()]
    assert all(v >= 0 for v in vals) and abs(sum(vals) - 1) < 1e-3
    assert vals == sorted(vals, reverse=True)


def test_rf_metrics_match_evaluator(spark):
    preds = catalog._rf_binary_predictions(spark, SF_SMALL).cache()
    ours = metrics.classification_metrics(preds).first()
    ref = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                            metricName="f1").evaluate(preds)
    assert math.isclose(ours["weighted_f1"], ref, rel_tol=1e-12)
    preds.unpersist()
