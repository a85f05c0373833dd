"""spark-submit entry: detect, translate, plan, download, list and info over files of lines.

Exit codes: 0 done, 1 failed, 2 bad arguments, 3 a missing file, 4 some texts failed to translate.
"""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import codes, literals
from verbaloom.operators import ngram_model, onnx_seq2seq, translate
from verbaloom.operators.detect import BatchDetector, Detector, LanguageDetection, NgramDetector, Policy
from verbaloom.plans import catalog, prepare, routing
from verbaloom.sources import fasttext_file, text_lines, weights


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbaloom")
    sub = p.add_subparsers(dest="command", required=True)

    def models(c: argparse.ArgumentParser) -> None:
        c.add_argument("file")
        c.add_argument("--model", help="a fastText file, by path or by its name in the cache")
        c.add_argument("--cache-dir")
        c.add_argument("--offline", action="store_true", help="only what is here already; a missing file ends the run")
        c.add_argument("--profile", choices=sorted(catalog.RULES), default="speed")
        c.add_argument("--train", help="parquet with text and lang, for the trigram model")
        c.add_argument("--min-letters", type=int)
        c.add_argument("--min-score", type=float)
        c.add_argument("--min-margin", type=float)
        c.add_argument("--candidates", nargs="+")
        c.add_argument("--json", action="store_true")

    models(sub.add_parser("detect"))
    t = sub.add_parser("translate")
    models(t)
    t.add_argument("--to", required=True)
    t.add_argument("--from", dest="source", default="auto")
    t.add_argument("--unknown-source", choices=("keep", "fallback", "raise"), default="keep")
    t.add_argument("--keep", action="append", default=[])
    t.add_argument("--keep-regex", action="append", default=[])
    t.add_argument("--no-preserve", action="store_true")
    t.add_argument("--no-preserve-kind", action="append", default=[], choices=literals.KINDS)
    t.add_argument("--truncate", action="store_true")
    t.add_argument("--split-long", action="store_true")
    t.add_argument("--translator", action="append", default=[], help="source:family:precision:folder, * for any source; without one, letters are swapped")
    d = sub.add_parser("download")
    d.add_argument("--pair", action="append", default=[], help="source:target")
    d.add_argument("--profile", choices=sorted(catalog.RULES), default="speed")
    d.add_argument("--files", required=True, help="JSON lines: family, precision, license, file, bytes, url, and sha256 if known")
    d.add_argument("--detector", help="url of the detector's file")
    d.add_argument("--no-detection", action="store_true")
    d.add_argument("--cache-dir")
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--force", action="store_true")
    plan = sub.add_parser("plan")
    plan.add_argument("--pair", action="append", required=True, help="source:target")
    plan.add_argument("--profile", choices=sorted(catalog.RULES), default="speed")
    listed = sub.add_parser("list")
    listed.add_argument("--files", help="JSON lines of a catalogue, for sizes and licences")
    info = sub.add_parser("info")
    info.add_argument("folder")
    return p


def detector(spark: SparkSession, a: argparse.Namespace) -> Detector:
    if a.model:
        if a.offline or a.cache_dir:
            a.model = str(weights.resolve(a.model, a.cache_dir))
        return BatchDetector(fasttext_file.opener(a.model))
    if not a.train:
        raise ValueError("name a --model or a table to --train on")
    return NgramDetector(ngram_model.train(spark.read.parquet(a.train), "text", "lang"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    return text_lines.read_lines(spark, path).withColumn("id", F.monotonically_increasing_id())


def detected(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    policy = Policy(a.min_letters, a.min_score, a.min_margin, tuple(a.candidates) if a.candidates else None)
    return LanguageDetection(detector(spark, a), policy).detect(numbered(spark, a.file), "id", "text")


def translator(a: argparse.Namespace) -> translate.Translator:
    """The models that the arguments name, one for each source; the stand-in where they name none."""
    routes, openers = {}, {}
    for spec in a.translator:
        source, family, precision, folder = spec.split(":", 3)
        folder = str(weights.resolve(folder, a.cache_dir))
        model = onnx_seq2seq.onnx_translator(folder, family, precision, targets=(a.to,), truncate=a.truncate, split_long=a.split_long)
        routes[None if source == "*" else source] = model.name
        openers[model.name] = lambda m=model: m
    if None in routes:
        routes |= {c: routes[None] for c in codes.LANGUAGES.values() if c not in routes and c != a.to}
    return translate.RoutedTranslator(routes, openers, (a.to,)) if routes else translate.LetterSwap()


def download(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fetches what the pairs' models need and what isn't there; prints each file and whether it was."""
    catalogue = spark.read.schema("family string, precision string, license string, file string, bytes long, url string, sha256 string").json(a.files)
    wanted = []
    if a.pair:
        models = prepare.chosen_models(spark, a.profile, [tuple(p.split(":")) for p in a.pair], catalogue).select("family", "precision").distinct()
        wanted = [(f"{r.family}-{r.precision}/{r.file}", r.url, r.sha256) for r in catalogue.join(models, ["family", "precision"]).orderBy("family", "precision", "file").collect()]
    if a.detector and not a.no_detection:
        wanted.append((f"detector/{a.detector.rpartition('/')[2]}", a.detector, None))
    root = weights.cache_dir(a.cache_dir)
    for name, url, sha256 in wanted:
        there = (root / name).exists()
        if not a.dry_run:
            weights.fetch(url, root / name, sha256, force=a.force)
        print(f"{'there' if there and not a.force else 'missing' if a.dry_run else 'fetched'}\t{name}")
    return 0


def show(df: DataFrame, column: str) -> None:
    for row in df.orderBy("id").select(column).toLocalIterator():
        print("" if row[0] is None else row[0])


def run(spark: SparkSession, argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "detect":
        found = detected(spark, a)
        fields = {"text": "text", **{c: f"_detection.{c}" for c in ("language", "status", "top_language", "score")}}
        if a.json:
            found = found.select("id", F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("line"))
        else:
            found = found.select("id", F.col("_detection.language").alias("line"))
        show(found, "line")
        return 0
    if a.command == "translate":
        keep = (*a.keep, *(re.compile(x) for x in a.keep_regex))
        kinds = False if a.no_preserve else tuple(k for k in literals.KINDS if k not in a.no_preserve_kind)
        work = translate.Translation(translator(a), a.to, kinds, keep, a.unknown_source)
        if a.source == "auto":
            part3 = {codes.PART1.get(c, c): c for c in codes.LANGUAGES.values()} | {c: c for c in codes.LANGUAGES.values()}
            done = work.translate(detected(spark, a), "text", "out", detection=F.col("_detection"), codes=part3, id_col="id")
        else:
            done = work.translate(numbered(spark, a.file), "text", "out", source=a.source)
        done = done.persist()
        line = F.to_json(F.struct("text", F.col("out").alias("translation"), F.col("out_status").alias("status"), F.col("out_error").alias("error"), F.col("out_source").alias("source_language"), F.col("out_model").alias("model"), F.col("out_preservation").alias("preservation"), *[F.col(f"out_{x}").alias(x) for x in ("input_truncated", "output_limit_reached", "input_split")]), {"ignoreNullFields": "false"}) if a.json else F.coalesce("out", "text")
        show(done.withColumn("line", line), "line")
        failed, total = done.agg(F.count_if(F.col("out_status") == "failed"), F.count(F.lit(1))).first()
        if failed:
            print(f"{failed} of {total} texts failed", file=sys.stderr)
        return 4 if failed else 0
    if a.command == "plan":
        rows = [(a.profile, *p.split(":")) for p in a.pair]
        requests = spark.createDataFrame(rows, "profile string, source string, target string")
        routing.choose(routing.candidates(requests, catalog.rules(spark), catalog.pairs(spark), catalog.model_languages(spark, list(codes.LANGUAGES.values())))).show(200, truncate=False)
        return 0
    if a.command == "download":
        return download(spark, a)
    if a.command == "list":
        profiles = catalog.rules(spark).groupBy("family", "precision").agg(F.array_join(F.sort_array(F.collect_set("profile")), ",").alias("profiles"))
        sides = catalog.model_languages(spark, list(codes.LANGUAGES.values())).unionAll(catalog.pairs(spark).select(F.lit("pair"), F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("code")), F.struct(F.lit("target").alias("side"), F.col("target").alias("code")))).alias("x")).select("pair", "x.side", "x.code"))
        counts = sides.groupBy("family").agg(F.count_distinct(F.when(F.col("side") == "source", F.col("code"))).alias("sources"), F.count_distinct(F.when(F.col("side") == "target", F.col("code"))).alias("targets"))
        out = profiles.join(counts, "family", "left")
        if a.files:
            catalogue = spark.read.schema("family string, precision string, license string, file string, bytes long").json(a.files)
            costs = routing.costs(catalogue, catalog.measured(spark)).select("family", "precision", "license", codes.human_size(F.col("bytes")).alias("size"), codes.human_size(F.col("memory_bytes")).alias("memory"))
            out = out.join(costs, ["family", "precision"], "left")
        out.orderBy("family", "precision").show(200, truncate=False)
        return 0
    text_lines.inventory(spark, a.folder).withColumn("size", codes.human_size(F.col("bytes"))).orderBy("model").show(200, truncate=False)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    spark = SparkSession.builder.appName("verbaloom").getOrCreate()
    try:
        return run(spark, argv)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 3
    except Exception as e:  # noqa: BLE001  the exit code says so
        text = str(e).splitlines()[0]
        print(text, file=sys.stderr)
        return 3 if "PATH_NOT_FOUND" in text else 1


if __name__ == "__main__":
    sys.exit(main())
