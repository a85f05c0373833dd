"""Which model a request gets and what it costs, as relational queries over the catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.plans import catalog


def candidates(requests: DataFrame, rules: DataFrame, pairs: DataFrame, languages: DataFrame) -> DataFrame:
    """Every (request, rule) that can serve it. requests(profile, source, target); a null source is an unknown one.

    A pair model needs its very pair. The small family reads any source, the large one needs a known source.
    """
    asked = requests.join(rules, "profile")
    own = asked.where("family = 'pair'").join(pairs, ["source", "target"], "left_semi")
    writes = languages.where("side = 'target'").select("family", F.col("code").alias("target"))
    reads = languages.where("side = 'source'").select("family", F.col("code").alias("source"))
    many = asked.where("family != 'pair'").join(writes, ["family", "target"], "left_semi")
    small = many.where("family = 'small'")
    large = many.where("family != 'small'").join(reads, ["family", "source"], "left_semi")
    columns = ["profile", "source", "target", "priority", "family", "precision"]
    return own.select(columns).unionByName(small.select(columns)).unionByName(large.select(columns))


def rejection(license: Column, size: Column, allowed: Iterable[str] | None = None, limit: int | None = None) -> Column:  # noqa: A002
    """Why a model isn't allowed, or null; licences compare without case."""
    if isinstance(allowed, str):
        raise TypeError("allowed is a list of licences")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError(f"the limit is a whole number of at least 0, not {limit!r}")
    out = F.lit(None).cast("string")
    if limit is not None:
        mb = float(catalog.MB)
        out = F.when(size > limit, F.concat(F.format_string("%.0f", size / mb), F.lit(f" MB is over the limit ({limit / mb:.0f} MB)")))
    if allowed is not None:
        out = F.when(~F.lower(license).isin(*[x.lower() for x in allowed] or [""]), F.concat(F.lit("licence "), license, F.lit(" is not allowed"))).otherwise(out)
    return out


def choose(found: DataFrame, costs: DataFrame | None = None, allowed: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
    """The first candidate of each request that the limits allow. costs(family, precision, license, bytes)."""
    if costs is not None:
        found = found.join(costs, ["family", "precision"], "left").where(rejection(F.col("license"), F.col("bytes"), allowed, limit).isNull())
    by = Window.partitionBy("profile", "source", "target").orderBy("priority")
    return found.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def costs(files: DataFrame, measured: DataFrame) -> DataFrame:
    """A row per model: files(family, precision, license, file, bytes) summed; memory measured, else estimated."""
    summed = files.groupBy("family", "precision", "license").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_files"))
    return summed.join(measured, ["family", "precision"], "left").select("family", "precision", "license", "bytes", "n_files", F.coalesce("measured_bytes", F.col("bytes") * catalog.ESTIMATE).alias("memory_bytes"), F.when(F.col("measured_bytes").isNotNull(), "measured").otherwise("estimated").alias("memory_basis"))


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The required files that aren't present; a model is cached when it has none."""
    return required.join(present, keys, "left_anti")


def totals(plan: DataFrame) -> DataFrame:
    """Sums over a plan's models, each once: download, what is missing, memory, licences."""
    return plan.dropDuplicates(["family", "precision"]).agg(
        F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("download_bytes"),
        F.coalesce(F.sum(F.when(~F.col("cached"), F.col("bytes"))), F.lit(0).cast("long")).alias("missing_bytes"),
        F.coalesce(F.sum("memory_bytes"), F.lit(0).cast("long")).alias("memory_bytes"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
    )


def language_sets(chosen: DataFrame) -> DataFrame:
    """(profile, side, code): the sources and targets that any pair of a profile reaches."""
    side = lambda name: chosen.where(F.col(name).isNotNull()).select("profile", F.lit(name).alias("side"), F.col(name).alias("code"))
    return side("source").unionAll(side("target")).distinct()


def supports(chosen: DataFrame, source: str | None, target: str) -> bool:
    """Whether any profile translates the pair; a null source is an unknown one."""
    return not chosen.where(F.col("source").eqNullSafe(F.lit(source)) & (F.col("target") == target)).isEmpty()


def reachable(chosen: DataFrame) -> DataFrame:
    """How many sources and targets each profile reaches."""
    return chosen.groupBy("profile").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))
