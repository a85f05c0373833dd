"""What models there are: families, precisions, files, measured memory and the pairs that have a model of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MB = 1 << 20
# Source-target pairs with a single-direction model.
PAIRS = tuple(
    tuple(p.split("-"))
    for p in """af-en ar-en cs-en da-de da-en de-en de-es de-fr en-af en-ar en-cs en-da en-de en-es en-fi en-fr en-hi en-hu en-id en-it en-nl en-ro
    en-ru en-sv en-uk en-vi en-xh en-zh es-de es-en es-fr es-it es-ru et-en fi-de fi-en fr-de fr-en fr-es fr-ro fr-ru hi-en hu-en id-en
    it-en it-es it-fr ja-en ko-en nl-en nl-fr no-de pl-en ro-fr ru-en ru-es ru-fr ru-uk sv-en th-en tr-en uk-en uk-ru vi-en xh-en zh-en""".split()
)
# The order in which a profile tries families and precisions.
RULES = {
    "speed": (("pair", "q4"), ("pair", "int8"), ("small", "int8")),
    "balance": (("pair", "q4"), ("pair", "int8"), ("large", "int8"), ("small", "int8")),
    "quality": (("pair", "fp32"), ("pair", "q4"), ("pair", "int8"), ("large", "fp32"), ("small", "int8")),
}
# Resident MB measured for a family and precision; 4 times the download where there is none.
MEASURED_MB = {("pair", "q4"): 1084, ("pair", "int8"): 630, ("pair", "fp32"): 1312, ("small", "int8"): 1151, ("medium", "int8"): 2375, ("large", "int8"): 4057, ("large", "fp32"): 3810}
ESTIMATE = 4
# Languages the small family writes, and those the large one lacks.
SMALL = tuple(
    """af am ar ast az ba be bg bn br bs ca ceb cs cy da de el en es et fa ff fi fr fy ga gd gl gu ha he hi hr ht hu hy id ig ilo is it ja jv ka
    kk km kn ko lb lg ln lo lt lv mg mk ml mn mr ms my ne nl no nso oc or pa pl ps pt ro ru sd si sk sl so sq sr ss su sv sw ta th tl tn tr
    uk ur uz vi wo xh yi yo zh zu""".split()
)
NOT_LARGE = ("br", "fy")


# What a precision adds to a graph's file name.
SUFFIXES = {"fp32": "", "int8": "_quantized", "q4": "_q4"}
#: Families whose decoder is one graph with and without a cache; the others have a graph without.
MERGED = ("pair", "large")


def model_files(family: str, precision: str) -> tuple[str, ...]:
    """The files a model of a family and precision needs: encoder, decoder, tokenizer, settings."""
    if precision not in SUFFIXES:
        raise ValueError(f"precisions are {', '.join(SUFFIXES)}, not {precision!r}")
    decoder = "decoder_model_merged" if family in MERGED else "decoder_model"
    return f"encoder_model{SUFFIXES[precision]}.onnx", f"{decoder}{SUFFIXES[precision]}.onnx", "tokenizer.json", "config.json"


def files_by_precision(spark: SparkSession) -> DataFrame:
    """model_files(family, precision, file) of every family and precision that a profile knows."""
    models = sorted({m for r in RULES.values() for m in r} | set(MEASURED_MB))
    return spark.createDataFrame([(f, p, n) for f, p in models for n in model_files(f, p)], "family string, precision string, file string")


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAIRS), "source string, target string")


def rules(spark: SparkSession) -> DataFrame:
    """rules(profile, priority, family, precision)"""
    return spark.createDataFrame([(p, i, f, x) for p, r in RULES.items() for i, (f, x) in enumerate(r)], "profile string, priority int, family string, precision string")


def model_languages(spark: SparkSession, codes: list[str]) -> DataFrame:
    """model_languages(family, side, code); the small family reads any source."""
    rows = [("large", side, c) for c in codes if c not in NOT_LARGE for side in ("source", "target")]
    rows += [("small", "target", c) for c in SMALL]
    return spark.createDataFrame(rows, "family string, side string, code string")


def measured(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, p, m * MB) for (f, p), m in MEASURED_MB.items()], "family string, precision string, measured_bytes long")
