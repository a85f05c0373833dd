"""Line dedup: a suffix array over line ids by prefix doubling, and deletion of later copies of repeated runs of lines.

A document is its sequence of lines. Doubling (suffix_order) ranks all suffixes that begin with a repeated line until each
has its own place in the array. Neighbours that share enough lines are an interval of the longest-common-prefix array, and
all suffixes of an interval but the one whose place comes first begin a later copy. A run counts if it has min_lines lines,
or one line of long_words words or more. What such copies cover in a document, joined, are its maximal repeated runs; each
is reported with the place of its original, and its lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, need, release
from .suffix_order import suffix_array

MIN_LINES = 2
LONG_WORDS = 50


def line_symbols(numbered: DataFrame, long_words: int) -> DataFrame:
    """id, row, at, tag and the symbol of every line; tag: 1 for a line of long_words words or more."""
    lines = numbered.select("id", "row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    many = (F.octet_length("line") >= 2 * long_words - 1) & (F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= long_words)
    return lines.select("id", "row", "at", many.cast("int").alias("tag"), F.xxhash64("line").alias("a"), F.hash("line").alias("b"), F.octet_length("line").alias("c"))


def repeated_runs(numbered: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """row and its maximal repeated runs: array<struct<s, e, first_id, first_row, first_line>>; only rows that have some.

    numbered: id, row, text. Lines s to e - 1 copy what begins at the first place, or a chain of such copies does.
    """
    symbols = cut(line_symbols(numbered, long_words), "lines")
    array = suffix_array(symbols, min_lines)
    release(symbols)
    place = F.struct("id", "row", "at")
    copied = lambda c: F.col(c).isNotNull() & (F.col(c) != place)
    size = F.when(copied("first_d"), min_lines).when((F.col("tag") == 1) & copied("first_1"), 1)
    later = array.select("row", "at", size.alias("size"), F.when(copied("first_d"), F.col("first_d")).otherwise(F.col("first_1")).alias("first")).where("size IS NOT NULL")
    later = later.select("row", F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e"), "first")
    by_row = Window.partitionBy("row").orderBy("s")
    reach = F.max("e").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    heads = later.withColumn("head", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    islands = heads.withColumn("island", F.sum("head").over(by_row))
    runs = islands.groupBy("row", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("first", "s").alias("f"))
    run = F.struct("s", "e", F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row"), F.col("f.at").alias("first_line"))
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _deduped(documents: DataFrame, id_col: str, text_col: str, min_lines: int, long_words: int) -> tuple[DataFrame, dict[str, str]]:
    """The rows under inner names, with text, n_lines, n_removed and n_runs; and the inner name of each column."""
    need(documents, id_col, text_col)
    if min_lines < 1 or long_words < 1:
        raise ValueError("min_lines and long_words are at least 1")
    at = {c: f"__in{i}" for i, c in enumerate(documents.columns)}
    numbered = cut(documents.toDF(*at.values()).withColumn("row", F.monotonically_increasing_id()), "numbered")
    runs = repeated_runs(numbered.select(F.col(at[id_col]).cast("long").alias("id"), "row", F.coalesce(at[text_col], F.lit("")).alias("text")), min_lines, long_words)
    joined = numbered.join(runs, "row", "left")
    text = F.col(at[text_col])
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.exists("runs", lambda r: (r.s <= i) & (i < r.e)))
    zero = F.lit(0).cast("long")
    return joined.select(
        *at.values(),
        F.when(F.col("runs").isNull(), text).otherwise(F.array_join(left, "\n")).alias("text"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", zero, lambda a, r: a + (r.e - r.s)), zero).alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
    ), at


def dedup_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """All rows and columns as they came, the text without its repeated lines, and n_lines, n_removed, n_runs.

    A line is deleted if it lies in a run that also starts earlier: in a smaller id, or earlier in the same document. A run
    has min_lines lines or more, or is one line of long_words words or more; runs may overlap and are judged on the input.
    Rows of one id follow one another in an order fixed at the start; a null id comes first. A null text stays null and
    an empty one empty; both count as one empty line. The last line needs no line feed. Empty tables give an empty result.
    Where the input has a column n_lines, n_removed or n_runs, it stays, and the new one has an underscore after its name.
    """
    found, at = _deduped(documents, id_col, text_col, min_lines, long_words)
    return found.select(
        *[(F.col("text") if c == text_col else F.col(at[c])).alias(c) for c in documents.columns],
        *[F.col(c).alias(free_name(documents, c)) for c in ("n_lines", "n_removed", "n_runs")],
    )


def keep_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents with their repeated lines deleted, columns as they came; chars_col follows a text that changed.

    A document that loses all its lines goes.
    """
    found, at = _deduped(documents, id_col, text_col, min_lines, long_words)
    changed = F.col("n_removed") > 0
    kinds = dict(documents.dtypes)
    new = {text_col: F.col("text")}
    if chars_col in at:
        new[chars_col] = F.when(changed, F.length("text").cast(kinds[chars_col])).otherwise(F.col(at[chars_col]))
    return found.where(~changed | (F.col("n_removed") < F.col("n_lines"))).select(*[new.get(c, F.col(at[c])).alias(c) for c in documents.columns])
