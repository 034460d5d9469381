"""Classification metrics as DataFrame aggregates.

Everything starts from the confusion counts, a partial + final aggregate over
the scored rows (at most classes^2 rows leave the map side). Per-class and
summary metrics are then computed from those counts in one more aggregate, so
five metrics cost one pass over the predictions instead of one evaluator job
each, and nothing is pulled to the driver.

Definitions (the ones Spark's ``MulticlassClassificationEvaluator`` uses):
precision_c = tp_c / predicted_c (0 when never predicted), recall_c =
tp_c / support_c, f1_c = 2 p r / (p + r) (0 when both are 0); weighted
averages weight each class by its support; accuracy = sum tp / rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))



def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     count: str = "n") -> DataFrame:
    """(label, prediction, n) for every observed pair."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias(count))


def confusion_matrix(df: DataFrame, classes, label: str = "label",
                     prediction: str = "prediction", prefix: str = "pred_") -> DataFrame:
    """Wide matrix: one row per label, one column ``pred_<class>`` per
    predicted class, and ``pred_other`` for predictions that are null or not in
    ``classes``, so a row's columns add up to its label's rows.

    ``classes`` is given (a bounded list); counts are a partial + final aggregate.
    """
    p = F.col(prediction)
    names = [prefix + (str(int(c)) if float(c).is_integer() else str(c).replace(".", "_")) for c in classes]
    other = ~F.coalesce(p.isin(list(classes)), F.lit(False))
    return df.groupBy(label).agg(*[F.count_if(p == F.lit(c)).alias(n) for c, n in zip(classes, names)],
                                 F.count_if(other).alias(prefix + "other"))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _div0(a: str, b: str) -> str:
    return f"coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D)"


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction",
              klass: str = "class") -> DataFrame:
    """(class, tp, predicted, support, precision, recall, f1) for every class
    seen as a label or as a prediction.

    Each scored row contributes to two classes (its label: support and maybe a
    true positive; its prediction: predicted), so one explode + one partial /
    final aggregate gives every count; at most ``classes`` rows per map task
    reach the shuffle. (Written as SQL expressions: the same plan, built with
    a few driver calls instead of thousands.)
    """
    l, p = f"CAST({_q(label)} AS DOUBLE)", f"CAST({_q(prediction)} AS DOUBLE)"
    contrib = (f"explode(array(named_struct('c', {l}, 'support', 1L, 'predicted', 0L, "
               f"'tp', IF({l} = {p}, 1L, 0L)), "
               f"named_struct('c', {p}, 'support', 0L, 'predicted', 1L, 'tp', 0L))) AS x")
    counts = (df.selectExpr(contrib).selectExpr("x.*").groupBy("c")
                .agg(F.expr("sum(tp) AS tp"), F.expr("sum(predicted) AS predicted"),
                     F.expr("sum(support) AS support")))
    pr = counts.selectExpr("c", "tp", "predicted", "support", f"{_div0('tp', 'predicted')} AS precision",
                           f"{_div0('tp', 'support')} AS recall")
    return pr.selectExpr(f"c AS {_q(klass)}", "tp", "predicted", "support", "precision", "recall",
                         f"{_div0('2 * precision * recall', 'precision + recall')} AS f1")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           digits: int | None = None) -> DataFrame:
    """One row: accuracy, weighted precision / recall / F1."""
    pc = per_class(df, label, prediction)
    out = pc.selectExpr(
        f"{_div0('sum(tp)', 'sum(support)')} AS accuracy",
        f"{_div0('sum(precision * support)', 'sum(support)')} AS weighted_precision",
        f"{_div0('sum(recall * support)', 'sum(support)')} AS weighted_recall",
        f"{_div0('sum(f1 * support)', 'sum(support)')} AS weighted_f1",
    )
    if digits is not None:
        out = out.selectExpr(*[f"round({c}, {digits}) AS {c}" for c in out.columns])
    return out


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 digits: int | None = None) -> DataFrame:
    """Per-class precision, recall, F1 and support, then the accuracy, macro
    average and weighted average rows (classes seen as label or prediction).

    One ``rollup`` over the per-class counts gives both the class rows and the
    grand total the summary rows are made of, so the predictions are scanned
    once.
    """
    pc = per_class(df, label, prediction)
    w = {m: F.sum(F.col(m) * F.col("support")) for m in ("precision", "recall", "f1")}
    r = pc.rollup("class").agg(
        F.grouping("class").alias("_g"),
        *[F.max(m).alias(m) for m in ("precision", "recall", "f1")],
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[v.alias(f"w_{m}") for m, v in w.items()],
        F.sum("tp").alias("tp"), F.sum("support").cast("long").alias("support"))
    n = F.col("support")

    def row(name, p, rc, f):
        return F.struct(name.alias("class"), p.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1"), n.alias("support"))

    c = F.col("class")
    name = F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    per = row(name, F.col("precision"), F.col("recall"), F.col("f1"))
    summary = F.array(
        row(F.lit("accuracy"), F.lit(None), F.lit(None), _safe_div(F.col("tp"), n)),
        row(F.lit("macro avg"), F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1")),
        row(F.lit("weighted avg"), *[_safe_div(F.col(f"w_{m}"), n) for m in ("precision", "recall", "f1")]),
    )
    out = r.select(F.explode(F.when(F.col("_g") == 0, F.array(per)).otherwise(summary)).alias("x")).select("x.*")
    if digits is not None:
        out = out.withColumns({m: F.round(m, digits) for m in ("precision", "recall", "f1")})
    return out


def learning_facts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: ``rows``, ``accuracy``, ``largest_share`` (of the labels, what a constant
    prediction reaches at best) and ``margin``, four standard deviations of a share
    of that many rows at most. A model has learned something if its accuracy on rows
    it has not seen is above ``largest_share + margin``. Null labels count as a class."""
    counts = confusion_counts(df, label, prediction)
    per = counts.groupBy(label).agg(F.sum("n").alias("n"), F.sum(
        F.when(F.col(label).eqNullSafe(F.col(prediction)), F.col("n")).otherwise(0)).alias("hit"))
    total = F.sum("n")
    return per.agg(total.alias("rows"), _safe_div(F.sum("hit"), total).alias("accuracy"),
                   _safe_div(F.max("n"), total).alias("largest_share"),
                   F.try_divide(F.lit(2.0), F.sqrt(total)).alias("margin"))
