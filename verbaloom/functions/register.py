"""The functions under SQL names: SELECT vl_rule_label(text) and the like, temporary functions of one session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import content, literals, segment


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, tuple[str, str]]:
    """Name, type and SQL body of the functions of one string t that SQL alone can say; they stay in generated code."""
    text, split = "coalesce(t, '')", f"split(coalesce(t, ''), {quoted(content.SPLIT)})"
    literal = f"w RLIKE {quoted('^(?:' + content.LITERAL_TOKEN + ')\\z')}"
    letters = lambda x: f"length(regexp_replace({x}, {quoted(r'\P{L}+')}, ''))"
    blank = f"{text} RLIKE {quoted(f'^[{content.WHITESPACE}]*\\z')}"
    linguistic = f"exists({split}, w -> w RLIKE {quoted(r'\p{L}')} AND NOT ({literal}))"
    return {
        "vl_is_blank": ("BOOLEAN", blank),
        "vl_has_linguistic_content": ("BOOLEAN", linguistic),
        "vl_letter_count": ("BIGINT", f"CAST({letters(text)} - aggregate(filter({split}, w -> (contains(w, '.') OR contains(w, '://')) AND {literal}), 0, (n, w) -> n + {letters('w')}) AS BIGINT)"),
        "vl_rule_label": ("STRING", f"CASE WHEN {blank} THEN 'und' WHEN NOT {linguistic} THEN 'zxx' END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql and gives their names. Calling it again replaces them."""

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = literals.Finder(literals.KINDS, ())
        for batch in batches:
            yield pd.Series([None if t is None else [{"kind": k, "start": a, "end": b, "text": t[a:b]} for a, b, k in finder.spans(t)] for t in batch], dtype=object)

    def sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else segment.segment(t)[0] for t in batch], dtype=object)

    for name, (kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register("vl_literals", F.pandas_udf(spans, literals.SPANS))
    spark.udf.register("vl_sentences", F.pandas_udf(sentences, "array<string>"))
    return [*definitions(), "vl_literals", "vl_sentences"]
