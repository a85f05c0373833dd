"""Evaluation of detections and translations as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def macro_accuracy(df: DataFrame, gold: str, predicted: str, languages: list[str] | None = None) -> DataFrame:
    """The mean over languages of each language's accuracy."""
    rows = df if languages is None else df.where(F.col(gold).isin(*languages))
    each = rows.groupBy(gold).agg(F.avg(F.when(F.col(gold) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"))
    return each.agg(F.count(F.lit(1)).alias("n_languages"), F.round(F.avg("accuracy"), 6).alias("macro_accuracy"))


def outcome(expected: Column, language: Column) -> Column:
    """right if the label is one of the expected ones (|-separated), abstained for und, else wrong."""
    return F.when(F.array_contains(F.split(expected, r"\|"), language), "right").when(language == "und", "abstained").otherwise("wrong")


def outcomes(df: DataFrame, category: str, expected: str, language: str) -> DataFrame:
    return df.select(F.col(category).alias("category"), outcome(F.col(expected), F.col(language)).alias("outcome")).groupBy("category", "outcome").agg(F.count(F.lit(1)).alias("n"))


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def known_to_all(labels: DataFrame, model: str, code: str) -> DataFrame:
    """The codes that every model knows. labels(model, code)"""
    n = labels.select(model).distinct().count()
    return labels.groupBy(code).agg(F.countDistinct(model).alias("n")).where(F.col("n") == n).select(code)


def literals_kept(spans: Column, output: Column) -> Column:
    """Whether each literal occurs in the output at least as often as in the spans."""
    texts = F.transform(spans, lambda x: x.text)
    times = lambda t: F.size(F.filter(texts, lambda y: y == t))
    found = lambda t: (F.length(output) - F.length(F.replace(output, t, F.lit("")))) / F.length(t)
    return F.forall(F.array_distinct(texts), lambda t: found(t) >= times(t))


def retention(df: DataFrame, spans: str, output: str, path: str) -> DataFrame:
    """By preservation path (none: no literals were looked for): texts with literals, those that kept all, and their share."""
    some = df.where(F.size(spans) > 0).select(F.coalesce(path, F.lit("none")).alias("path"), literals_kept(F.col(spans), F.col(output)).alias("kept"))
    return some.groupBy("path").agg(F.count(F.lit(1)).alias("texts"), F.count_if("kept").alias("kept"), F.round(F.avg(F.col("kept").cast("int")), 6).alias("share"))
