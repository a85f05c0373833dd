"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document gets two histograms: classes of characters (upper-case letters, other letters and digits, symbols, all else) and the common
words of its language, with all other words in one more bin. References are the means of these histograms over all
documents of the language that pass the base rules. A document is rejected when the Jensen-Shannon distance of either
histogram to its reference is too large; the guards leave short documents and thin references unjudged.

One pass over the texts makes the histograms, which are written once; the references are a few rows per language, and
the planner broadcasts them only if the written file is under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, need

#: The most common words of each language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
}
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
OTHER = r"[^\p{L}\p{Nd}#*$%&|<>\x20\x09-\x0D]"
LONGEST = max(len(w) for words in COMMON_WORDS.values() for w in words)

#: A sample of n words has a distance of some noise / sqrt(n) to its own source; that much is granted to every text.
DEFAULTS = {"min_words": 60, "max_char_distance": 0.15, "max_word_distance": 0.05, "word_noise": 3.2, "min_reference_docs": 20}


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and body with it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash; sorting brings equal ones together, and only texts with equal ones are sorted.
    """
    hashes = "transform(words, w -> xxhash64(w))"
    windows = "slice(zip_with(zip_with(h, slice(h, 2, size(h)), (a, b) -> xxhash64(a, b)), slice(h, 3, size(h)), (a, b) -> xxhash64(a, b)), 1, size(h) - 2)"
    placed = "array_sort(transform(g, (x, i) -> struct(x AS x, i AS i)))"
    same = "zip_with(s, slice(s, 2, size(s)), (a, b) -> a.x = b.x)"
    places = "array_sort(filter(transform(s, (a, k) -> IF(coalesce(e[k], false) OR (k > 0 AND e[greatest(k - 1, 0)]), a.i, -1)), p -> p >= 0))"
    total = "aggregate(p, struct(-3 AS last, 0L AS n), (t, i) -> struct(i AS last, t.n + least(3, i - t.last) AS n), t -> t.n)"
    heavy = _let(placed, "s", _let(same, "e", _let(places, "p", total)))
    return f"IF(size(words) < 4, 0L, {_let(hashes, 'h', _let(windows, 'g', f'IF(size(array_distinct(g)) = size(g), 0L, {heavy})'))})"


def features(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts and both histograms of every document."""
    texts = documents.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(lang_col).alias("__lang"))
    words = texts.withColumn("words", F.array_remove(F.split("__text", SPACE), ""))
    common = "CASE __lang " + " ".join(f"WHEN '{k}' THEN array({', '.join(repr(w) for w in v)})" for k, v in COMMON_WORDS.items()) + " END"
    bins = len(next(iter(COMMON_WORDS.values())))
    counted = words.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
            "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_repeat_words": F.expr(_repeat_words()),
            "__upper": F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long"),
            "__other": F.regexp_count("__text", F.lit(OTHER)).cast("long"),  # rare, so far cheaper to count than letters
            "__common": F.expr(_let(common, "c", f"filter(transform(filter(words, w -> length(w) <= {LONGEST}), w -> array_position(c, lower(w))), i -> i > 0)")),
        }
    )
    histograms = counted.withColumns(
        {
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "char_bins": F.array(F.col("word_chars") - F.col("__upper") - F.col("n_symbols") - F.col("__other"), "__upper", "n_symbols", "__other"),
            "word_bins": F.when(F.col("__common").isNotNull(), F.array(*[(F.size("__common") - F.size(F.array_remove("__common", F.lit(k).cast("long")))).cast("long") for k in range(1, bins + 1)], F.col("n_words") - F.size("__common"))),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return histograms.withColumn("base_failed", failed).select(*keep, F.coalesce("__lang", F.lit("")).alias("__lang"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_bins", "word_bins")


def references(found: DataFrame, min_words: int) -> DataFrame:
    """A row per language: the mean share of each bin, and how many documents it rests on."""
    n_chars = 4
    n_bins = len(next(iter(COMMON_WORDS.values()))) + 1
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    good = found.where(~F.col("base_failed") & (F.col("n_words") >= min_words)).withColumns({"__c": total("char_bins"), "__w": total("word_bins")})
    share = lambda c, i, t: F.avg(F.when(F.col(t) > 0, F.col(c)[i] / F.col(t)))
    return good.groupBy("__lang").agg(
        F.count(F.lit(1)).alias("__docs"),
        F.array(*[share("char_bins", i, "__c") for i in range(n_chars)]).alias("__char_ref"),
        F.array(*[share("word_bins", i, "__w") for i in range(n_bins)]).alias("__word_ref"),
    )


def js_distance(counts: str, shares: str) -> str:
    """SQL: the Jensen-Shannon distance (base 2, 0 to 1) of a histogram and a reference."""
    total = f"greatest(aggregate({counts}, 0L, (a, x) -> a + x), 1L)"
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0D END"
    both = f"({term.format('z.p', 'z.q')} + {term.format('z.q', 'z.p')})"
    summed = f"aggregate(zip_with(transform({counts}, x -> x / t), {shares}, (p, q) -> struct(p AS p, q AS q)), 0D, (a, z) -> a + {both})"
    return f"sqrt(greatest(0D, 0.5D * {_let(total, 't', summed)}))"


def judge(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None, **limits) -> DataFrame:
    """The kept columns (the id alone unless named), the base counts, both distances and the verdict, a row per document.

    Null text counts as empty and fails the base rules. A null or unlisted language has no common-word histogram, and
    only its characters are judged; a language with too few reference documents isn't judged. Repeated rows are judged
    alike. An empty table gives an empty result. Texts of any length are taken whole.
    """
    need(documents, id_col, text_col, lang_col)
    p = DEFAULTS | limits
    keep = (id_col,) if keep is None else keep
    found = cut(features(documents, text_col=text_col, lang_col=lang_col, keep=keep), "quality")
    refs = cut(references(found, p["min_words"]).coalesce(1), "quality-reference")
    scored = found.join(refs, "__lang", "left").withColumns({"char_distance": F.expr(js_distance("char_bins", "__char_ref")), "word_distance": F.expr(js_distance("word_bins", "__word_ref"))})
    known = (F.col("n_words") >= p["min_words"]) & (F.coalesce("__docs", F.lit(0)) >= p["min_reference_docs"])
    far = known & ((F.coalesce("char_distance", F.lit(0.0)) > p["max_char_distance"]) | (F.coalesce("word_distance", F.lit(0.0)) > p["max_word_distance"] + p["word_noise"] / F.sqrt(F.greatest("n_words", F.lit(1)))))
    return scored.withColumn("kept", ~F.col("base_failed") & ~far).select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def keep_good(documents: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns and order of columns they came with."""
    columns = documents.columns
    inner = {c: f"__in{i}" for i, c in enumerate(columns)}
    names = {k: inner[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("lang_col", "lang"))}
    renamed = documents.toDF(*inner.values())
    judged = judge(renamed, keep=tuple(inner.values()), **names, **options).where("kept")
    return judged.select(*[F.col(inner[c]).alias(c) for c in columns])
