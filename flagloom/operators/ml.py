"""Clustering and classification on tables with Spark ML.

Fits are iterative, so their input is persisted (memory, then executor disks)
for the duration of the fit; a lost executor recomputes its partitions from
lineage. Where the input is dear to derive, write it first
(``pipeline.write_stage``) and fit from the files. Spark's KMeans and
forests depend on the partitioning even with a fixed seed: a result holds for
one stated layout (``key`` and ``rows_per_partition``) only. The number of
partitions follows from one count, so a fit has as many tasks as its rows need
under any session setting. ``hash_split`` assigns
train/test by a hash of the key, independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flagloom.operators.rank import top_n_measures
from flagloom.sources.io import small_table


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Numeric / boolean columns -> one vector column.

    Default ``"error"`` fails on nulls: fill first (``clean.fill_zero``).
    ``"keep"`` writes NaN, ``"skip"`` drops the row.
    """
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)


def array_features(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    """array<float|double> column -> vector column (JVM-side, no UDF)."""
    return df.withColumn(out, array_to_vector(F.col(col)))


def vector_values(c: str | Column) -> Column:
    return vector_to_array(F.col(c) if isinstance(c, str) else c)


def _fit_input(df: DataFrame, key: str | None, rows_per_partition: int | None) -> DataFrame:
    """The layout the caller states: rows dealt by the hash of ``key`` (which tells
    rows apart) to as many partitions as they need and ordered by it, so that equal
    data is fitted equally under any session setting. Without both, the input's own
    layout stays."""
    if (key is None) != (rows_per_partition is None):
        raise ValueError("a layout is a key and a number of rows per partition")
    if key is not None:
        df = df.repartition(fit_partitions(df, rows_per_partition), key).sortWithinPartitions(key)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fit_partitions(df: DataFrame, rows_per_partition: int) -> int:
    """Partitions of ``rows_per_partition`` rows (on average) that ``df`` needs; one count."""
    if rows_per_partition < 1:
        raise ValueError("rows_per_partition must be positive")
    return max(1, -(-df.count() // rows_per_partition))


def fit_kmeans(df: DataFrame, k: int, seed: int, features: str = "features", prediction: str = "cluster",
               key: str | None = None, rows_per_partition: int | None = None, max_iter: int = 20):
    data = _fit_input(df.select(*([key] if key else []), features), key, rows_per_partition)
    try:
        return KMeans(featuresCol=features, predictionCol=prediction, k=k, seed=seed,
                      maxIter=max_iter).fit(data)
    finally:
        data.unpersist()


def assign_clusters(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


HASH_RANGE = 1 << 32


def hash_bucket(key: str | Column, seed: int) -> Column:
    """Stable number in [0, 2^32) from md5(seed|key): same on any layout.

    All null keys have one number, that of the seed alone."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), k))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, train_fraction: float = 0.8, seed: int = 42,
               bucket: str = "bucket", out: str = "split", labels=("train", "test")) -> DataFrame:
    """Tag every row train/test by its key's 32-bit hash against ``train_fraction``
    of the range; rows with a null key all fall on one side."""
    cut = train_fraction * HASH_RANGE
    return df.withColumn(bucket, hash_bucket(key, seed)).withColumn(
        out, F.when(F.col(bucket) < cut, F.lit(labels[0])).otherwise(F.lit(labels[1])))


def split_frames(df: DataFrame, key: str, train_fraction: float = 0.8, seed: int = 42):
    tagged = hash_split(df, key, train_fraction, seed, bucket="_bucket", out="_split")
    train = tagged.where(F.col("_split") == "train").drop("_bucket", "_split")
    test = tagged.where(F.col("_split") == "test").drop("_bucket", "_split")
    return train, test


def redraw_labels(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with every label drawn anew from the labels' own shares by the hash
    of the row's key: the shares stay, what the features say about them goes.

    A null label stays a class of its own. The shares (one row per class) are the
    only thing that reaches the driver, so no row is moved."""
    shares = df.groupBy(label).count().orderBy(label).collect()
    total, upto, draw = sum(r["count"] for r in shares), 0, F.lit(None)
    bounds = []
    for r in shares:
        upto += r["count"]
        bounds.append((upto * HASH_RANGE // total, r[label]))
    for bound, value in reversed(bounds):
        draw = F.when(hash_bucket(key, seed) < bound, F.lit(value)).otherwise(draw)
    draw = draw.cast(df.schema[label].dataType)
    return df.withColumn(label, draw)


def _tagged_tokens(sources: Mapping[str, str]) -> Column:
    """All (source, token) of a row's array columns in one array."""
    def tag(source: str):
        return lambda t: F.struct(F.lit(source).alias("source"), t.alias("token"))

    return F.concat(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), tag(s))
                      for s, c in sources.items()])


def token_dictionary(df: DataFrame, sources: Mapping[str, str], path: str) -> DataFrame:
    """``(source, token, index)`` of the distinct tokens of array columns, numbered
    from 0 in the order of source and token.

    ``sources`` names each array column's source. The tokens are sorted and written
    to ``path``; a token's number is its row in its file plus the rows of the files
    before, so no task holds the dictionary (only the files' counts meet)."""
    tokens = df.select(F.explode(_tagged_tokens(sources)).alias("x")).select("x.*").where("token IS NOT NULL").distinct()
    tokens.orderBy("source", "token").write.parquet(path)
    rows = df.sparkSession.read.schema("source string, token string").parquet(path).select(
        "source", "token", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(files, "file").select("source", "token", (F.col("before") + F.col("row")).cast("int").alias("index"))


#: A sparse vector as Spark stores it.
_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def sparse_features(df: DataFrame, key: str, sources: Mapping[str, str], dictionary: DataFrame, path: str,
                    out: str = "features") -> DataFrame:
    """``(key, out)``: a 0/1 sparse vector with a place for every row of ``dictionary``.

    No column per token: tokens meet their numbers by a join and are gathered by
    row, then written to ``path`` in the form in which Spark stores vectors and read
    back as vectors (:func:`sparse_pairs` reads them as pairs). ``key`` tells rows
    apart. A null or empty array, and tokens that are not in the dictionary, set
    nothing; a token set twice counts once."""
    size = dictionary.count()
    found = (df.select(key, F.explode(_tagged_tokens(sources)).alias("x")).select(key, "x.*").join(dictionary, ["source", "token"])
             .groupBy(key).agg(F.sort_array(F.collect_set("index")).alias("indices")))
    indices = F.coalesce("indices", F.array().cast("array<int>"))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"),
                      F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    df.select(key).join(found, key, "left").select(key, vector.alias(out)).write.parquet(path)
    kept = df.select(key).schema
    return df.sparkSession.read.schema(StructType([*kept.fields, StructField(out, VectorUDT())])).parquet(path)


def sparse_pairs(spark: SparkSession, path: str, key: str, out: str = "features") -> DataFrame:
    """``(key, index, value)`` of the vectors that :func:`sparse_features` wrote."""
    rows = spark.read.parquet(path)
    kind = rows.schema[key].dataType.simpleString()
    rows = spark.read.schema(f"{key} {kind}, {out} {_SPARSE}").parquet(path)
    return (rows.select(key, F.explode(F.arrays_zip(F.col(out)["indices"].alias("index"), F.col(out)["values"].alias("value")))
                        .alias("x")).select(key, "x.index", "x.value"))


def forest(label: str, features: str = "features", trees: int = 20, seed: int = 42,
           prediction: str = "prediction", max_depth: int = 5) -> RandomForestClassifier:
    """A random forest with a required seed (an unseeded forest differs per run)."""
    return RandomForestClassifier(labelCol=label, featuresCol=features, predictionCol=prediction,
                                  numTrees=trees, seed=seed, maxDepth=max_depth)


def fit_forest(df: DataFrame, label: str, features: str = "features", trees: int = 20, seed: int = 42,
               key: str | None = None, rows_per_partition: int | None = None, max_depth: int = 5):
    data = _fit_input(df.select(*([key] if key else []), label, features), key, rows_per_partition)
    try:
        return forest(label, features, trees, seed, max_depth=max_depth).fit(data)
    finally:
        data.unpersist()


def fit_forest_pipeline(df: DataFrame, feature_cols: Sequence[str], label: str, trees: int = 20,
                        seed: int = 42, key: str | None = None, rows_per_partition: int | None = None,
                        vector: str = "rf_features"):
    """Assembler + forest as one Pipeline, fitted on ``df``."""
    cols = list(dict.fromkeys([*([key] if key else []), label, *feature_cols]))
    data = _fit_input(df.select(*cols), key, rows_per_partition)
    try:
        stages = [VectorAssembler(inputCols=list(feature_cols), outputCol=vector),
                  forest(label, vector, trees, seed)]
        return Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()


def feature_importances(spark: SparkSession, model, names: Sequence[str], digits: int = 4,
                        feature: str = "feature", importance: str = "importance") -> DataFrame:
    """(feature, importance) from a fitted tree ensemble (or a pipeline ending
    in one), rounded, most important first. Bounded by the feature count."""
    m = model.stages[-1] if hasattr(model, "stages") else model
    values = m.featureImportances.toArray().tolist()
    rows = [(n, round(float(v), digits)) for n, v in zip(names, values)]
    df = small_table(spark, rows, f"{feature} string, {importance} double")
    return df.orderBy(F.col(importance).desc(), F.col(feature))


def describe_clusters(profile: DataFrame, key: str, minutes: str, seasons: str, year: str,
                      features: Sequence[str], year_cut: float = 2015, long_minutes: float = 90,
                      multi_seasons: float = 1, n: int = 3, strip_prefix: str = "avg_") -> DataFrame:
    """Rule-based text per cluster from its mean profile (one row per cluster).

    length: mean minutes > ``long_minutes`` -> 'full-length', else mean seasons
    > ``multi_seasons`` -> 'multi-season', else 'short-or-single'; era: mean
    year > ``year_cut`` -> 'recent' else 'older'; plus the ``n`` largest of the
    named feature means.
    """
    noted = profile.withColumns({
        "length_note": F.when(F.col(minutes) > long_minutes, F.lit("full-length"))
                        .when(F.col(seasons) > multi_seasons, F.lit("multi-season"))
                        .otherwise(F.lit("short-or-single")),
        "era_note": F.when(F.col(year) > year_cut, F.lit("recent")).otherwise(F.lit("older")),
    })
    # notes ride along as ids through the unpivot, so one pass, no join back
    return top_n_measures(noted, [key, "length_note", "era_note"], list(features), n=n,
                          joined="top_features", strip_prefix=strip_prefix)
