"""What a profile would load for some pairs, and what of it is missing, before anything is loaded."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import codes
from verbaloom.plans import catalog, routing


class Unsupported(ValueError):
    """No model of the profile translates a pair."""


class Constrained(Unsupported):
    """Models of the profile translate it, but the limits reject them all."""


def chosen_models(spark: SparkSession, profile: str, pairs: Iterable[tuple[str | None, str]], files: DataFrame, *, allowed: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
    """(source, target, family, precision) of each pair, a null source being an unknown one. Raises before any work."""
    pairs = [(None if s in (None, "auto") else s, t) for s, t in pairs]
    if profile not in catalog.RULES:
        raise ValueError(f"profiles are {', '.join(catalog.RULES)}")
    known = list(codes.LANGUAGES.values())
    if unknown := sorted({c for p in pairs for c in p if c is not None} - set(known)):
        raise Unsupported(f"no such language: {', '.join(unknown)}")
    requests = spark.createDataFrame([(profile, s, t) for s, t in pairs], "profile string, source string, target string")
    found = routing.candidates(requests, catalog.rules(spark), catalog.pairs(spark), catalog.model_languages(spark, known))
    costs = routing.costs(files, catalog.measured(spark))
    chosen = routing.choose(found, costs, allowed, limit).select("source", "target", "family", "precision").collect()  # a row per pair asked for
    served = {(r.source, r.target) for r in chosen}
    if lost := [p for p in pairs if p not in served]:
        able = {(r.source, r.target) for r in found.select("source", "target").distinct().collect()}
        kind = Constrained if lost[0] in able else Unsupported
        raise kind(f"no {profile} model for {lost[0][0] or 'an unknown source'} to {lost[0][1]}" + (" within the limits" if kind is Constrained else ""))
    return spark.createDataFrame(chosen, "source string, target string, family string, precision string")


def plan(spark: SparkSession, profile: str, pairs: Iterable[tuple[str | None, str]], files: DataFrame, present: DataFrame, **limits) -> DataFrame:
    """A row per model: files, bytes, memory, licence, and whether all its files are present. present(family, precision, file)"""
    models = chosen_models(spark, profile, pairs, files, **limits).select("family", "precision").distinct()
    gaps = routing.missing(files, present, ["family", "precision", "file"]).select("family", "precision").distinct().withColumn("gap", F.lit(True))
    costed = models.join(routing.costs(files, catalog.measured(spark)), ["family", "precision"])
    return costed.join(gaps, ["family", "precision"], "left").withColumn("cached", F.col("gap").isNull()).drop("gap")
