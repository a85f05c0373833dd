"""The library's own queries: each operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import codes, content, literals, segment
from verbaloom.operators import evaluate, ngram_model, translate
from verbaloom.operators.detect import BatchDetector, LanguageDetection, NgramDetector, Policy, as_json_line, collapse_scores
from verbaloom.plans import catalog, routing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang")


def model(spark: SparkSession, d: str) -> ngram_model.NgramModel:
    return ngram_model.train(docs(spark, d), "text", "lang")


def detected(spark: SparkSession, d: str, policy: Policy | None = None) -> DataFrame:
    return LanguageDetection(NgramDetector(model(spark, d)), policy or Policy()).detect(docs(spark, d), "doc_id", "text")


def flat(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("_detection.language").alias("language"), F.col("_detection.status").alias("status"), F.col("_detection.top_language").alias("top_language"), F.round("_detection.score", 4).alias("score"))


def rounded(x: Column, places: int) -> Column:
    """x as SQL engines round it, by its product with a power of ten; Spark's own round goes by the digits that x prints as."""
    by = float(10**places)
    return F.round(x * by) / by


# Content


@query
def rule_label(spark, d):
    urls = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("text"))
    texts = docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return texts.unionAll(urls).select("id", content.rule_label(F.col("text")).alias("rule"))


@query
def letter_count(spark, d):
    return docs(spark, d).select("doc_id", content.letter_count(F.col("text")).cast("long").alias("letters"))


@query
def linguistic_content(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", content.has_linguistic_content(F.col("text")).alias("linguistic"), content.is_blank(F.col("text")).alias("blank"))


@query
def min_letters_gate(spark, d):
    n = content.letter_count(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(n < 40, "insufficient_text").otherwise("model").alias("gate"))


@query
def literal_tokens(spark, d):
    words = table(spark, d, "pages").select(F.explode(content.tokens(F.col("url"))).alias("w")).unionAll(docs(spark, d).select(F.explode(content.tokens(F.col("text"))).alias("w")))
    return words.where(content.is_literal_token(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


# Codes


def label_variants(spark, d):
    """Native spellings of each language of the corpus, one per model family."""
    langs = docs(spark, d).select("lang").distinct()
    forms = F.array(F.concat(F.lit("__label__"), "lang"), F.upper("lang"), F.concat("lang", F.lit("-Latn")), F.concat(F.lit("__label__"), "lang", F.lit("_Latn")))
    extra = spark.createDataFrame([(x,) for x in ("__label__als", "iw", "zh-Hant", "cmn_Hans", "__label__nno_Latn", "nb", "scr", "xx", "ary", "sh")], "label string")
    return langs.select(F.explode(forms).alias("label")).unionAll(extra)


@query
def iso_normalize(spark, d):
    return label_variants(spark, d).select("label", codes.to_iso639_3(F.col("label")).alias("code"))


@query
def macro_collapse(spark, d):
    return label_variants(spark, d).select("label", codes.to_iso639_3(F.col("label"), collapse=True).alias("code"))


@query
def to_language(spark, d):
    names = spark.createDataFrame([(x,) for x in ("Spanish", "norwegian nynorsk", "es-ES", "zho_Hans", "cmn", "arb", "nob", "yue", "ary", "iw", "als", "und", "zxx", "klingon", " PT ")], "value string")
    values = docs(spark, d).select(F.col("lang").alias("value")).distinct().unionAll(names)
    return values.select("value", codes.to_language(F.col("value"), F.lit("?")).alias("code"))


@query
def compact_labels(spark, d):
    return table(spark, d, "nation").select("n_name", codes.decode_compact(F.lower("n_name")).alias("code"))


@query
def label_collapse_scores(spark, d):
    """Documents as votes: each label spelling has the share of its language's documents, summed by code."""
    votes = docs(spark, d).groupBy("lang").agg((F.count(F.lit(1)) * 1.0).alias("score"))
    labels = votes.select(F.explode(F.array(F.concat(F.lit("__label__"), "lang"), F.upper("lang"))).alias("label"), "score")
    out = collapse_scores(labels, [], codes.to_iso639_3(F.col("label")))
    return out.select("language", "score")


@query
def model_sizes(spark, d):
    sizes = docs(spark, d).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return sizes.select("lang", codes.human_size(F.col("bytes")).alias("size"))


# Model and policy


@query
def nb_train(spark, d):
    return model(spark, d).table.select("language", "gram", F.round("logp", 4).alias("logp"))


@query
def nb_scores(spark, d):
    return model(spark, d).scores(docs(spark, d), "doc_id", "text").select("doc_id", "language", F.round("score", 2).alias("score"))


@query
def nb_top1(spark, d):
    return model(spark, d).ranked(docs(spark, d), "doc_id", "text").select("doc_id", F.col("scores")[0].language.alias("language"))


@query
def nb_topk(spark, d):
    ranked = model(spark, d).ranked(docs(spark, d), "doc_id", "text")
    return ranked.select("doc_id", F.posexplode(F.slice("scores", 1, 2)).alias("rank", "s")).select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("s.language").alias("language"))


@query
def nb_softmax(spark, d):
    ranked = model(spark, d).ranked(docs(spark, d), "doc_id", "text")
    return ranked.select("doc_id", F.explode("scores").alias("s")).select("doc_id", F.col("s.language").alias("language"), F.round("s.score", 4).alias("probability"))


@query
def lang_histogram(spark, d):
    found = detected(spark, d)
    return found.groupBy("lang", F.col("_detection.language").alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query
def detect_detailed(spark, d):
    return flat(detected(spark, d))


@query
def detect_min_letters(spark, d):
    return flat(detected(spark, d, Policy(min_letters=200)))


@query
def detect_min_score(spark, d):
    return flat(detected(spark, d, Policy(min_score=0.9999)))


@query
def detect_min_margin(spark, d):
    return flat(detected(spark, d, Policy(min_margin=0.9999)))


@query
def detect_candidates(spark, d):
    return flat(detected(spark, d, Policy(candidates=("de", "fr"))))


@query
def confident_rows(spark, d):
    found = detected(spark, d)
    first = F.get("_scores", F.lit(0))
    return found.where((first.language == "en") & (first.score >= 0.8)).select("doc_id")


@query
def detect_status_counts(spark, d):
    found = detected(spark, d, Policy(min_letters=200, min_score=0.9999))
    return found.groupBy(F.col("_detection.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def detect_json_lines(spark, d):
    found = detected(spark, d)
    line = as_json_line(F.col("doc_id").cast("string"), F.struct(F.col("_detection.language"), F.col("_detection.status"), F.col("_detection.top_language"), F.round("_detection.score", 1).alias("score")))
    return found.select("doc_id", line.alias("line"))


def _longest_word_model():
    """A stand-in model for Arrow batches: scores by the share of vowels."""
    def predict(texts):
        out = []
        for t in texts:
            share = sum(c in "aeiouAEIOU" for c in t) / max(len(t), 1)
            out.append([("vow", share), ("con", 1 - share)])
        return out

    return predict


@query
def detect_batch_model(spark, d):
    """Texts are vow where vowels are more than half, else con, so con leads the axis by which equal scores are ordered."""
    detection = LanguageDetection(BatchDetector(_longest_word_model, ("con", "vow")), Policy(min_letters=4))
    found = detection.detect(docs(spark, d), "doc_id", "text")
    return found.select("doc_id", F.col("_detection.language").alias("language"), rounded(F.col("_detection.score"), 4).alias("score"))


# Routing and cost


def language_codes():
    return list(codes.LANGUAGES.values())


def requests(spark, profiles=("speed", "balance", "quality"), sources=None, targets=None):
    sources = language_codes() if sources is None else sources
    rows = spark.createDataFrame([(c,) for c in sources], "source string").join(spark.createDataFrame([(c,) for c in targets or language_codes()], "target string"), ~F.col("source").eqNullSafe(F.col("target")))
    return rows.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in profiles])))


def files(spark):
    """A catalogue of files by rule: precision and family set the size."""
    rows = []
    sizes = {("pair", "q4"): 280, ("pair", "int8"): 105, ("pair", "fp32"): 420, ("small", "int8"): 590, ("medium", "int8"): 640, ("large", "int8"): 1100, ("large", "fp32"): 2900}
    licences = {"pair": "Apache-2.0", "large": "CC-BY-NC-4.0"}
    for (family, precision), mb in sizes.items():
        for name, percent in (("encoder.onnx", 40), ("decoder.onnx", 59), ("tokenizer.json", 1)):
            rows.append((family, precision, licences.get(family, "MIT"), name, mb * percent * catalog.MB // 100))
    return spark.createDataFrame(rows, "family string, precision string, license string, file string, bytes long")


def routed(spark, allowed=None, limit=None, **options):
    found = routing.candidates(requests(spark, **options), catalog.rules(spark), catalog.pairs(spark), catalog.model_languages(spark, language_codes()))
    costs = routing.costs(files(spark), catalog.measured(spark)) if allowed is not None or limit is not None else None
    return routing.choose(found, costs, allowed, limit)


@query
def route_pairs(spark, d):
    """The model of each profile for each pair of the corpus' languages."""
    known = [r.lang for r in docs(spark, d).select("lang").distinct().orderBy("lang").collect()]
    return routed(spark, sources=known, targets=known).select("profile", "source", "target", "family", "precision")


@query
def route_constrained(spark, d):
    known = [r.lang for r in docs(spark, d).select("lang").distinct().orderBy("lang").collect()]
    return routed(spark, allowed=["apache-2.0", "mit"], limit=200 * catalog.MB, sources=known, targets=known).select("profile", "source", "target", "family", "precision")


@query
def auto_choices(spark, d):
    """The model of each source, an unknown one included; its row has a null source."""
    return routed(spark, sources=[*language_codes(), None], targets=["en"], profiles=("balance",)).select("source", "family", "precision")


@query
def supported_languages(spark, d):
    return routing.reachable(routed(spark))


@query
def supported_language_sets(spark, d):
    return routing.language_sets(routed(spark, profiles=("quality",)))


@query
def language_union(spark, d):
    """Languages that the small or the large family writes, and whether the catalogue names them: both sets are one."""
    written = catalog.model_languages(spark, language_codes()).where("side = 'target'").select("code").union(catalog.pairs(spark).select("target")).distinct()
    named = codes.languages(spark).select("code").withColumn("named", F.lit(True))
    return written.withColumn("written", F.lit(True)).join(named, "code", "full").groupBy("written", "named").agg(F.count(F.lit(1)).alias("n"))


@query
def model_file_names(spark, d):
    return catalog.files_by_precision(spark)


@query
def model_costs(spark, d):
    return routing.costs(files(spark), catalog.measured(spark))


@query
def rejected_models(spark, d):
    costs = routing.costs(files(spark), catalog.measured(spark))
    return costs.select("family", "precision", routing.rejection(F.col("license"), F.col("bytes"), ["apache-2.0"], 300 * catalog.MB).alias("reason"))


@query
def cache_missing(spark, d):
    present = files(spark).where("file != 'decoder.onnx' OR family = 'pair'").select("family", "precision", "file")
    return routing.missing(files(spark), present, ["family", "precision", "file"]).select("family", "precision", "file", "bytes")


@query
def plan_totals(spark, d):
    costs = routing.costs(files(spark), catalog.measured(spark)).withColumn("cached", F.col("family") == "pair")
    chosen = routed(spark, sources=["de", "fr", "es", "bo"], targets=["en"], profiles=("balance",)).select("family", "precision")
    return routing.totals(chosen.join(costs, ["family", "precision"]))


@query
def catalog_list(spark, d):
    profiles = catalog.rules(spark).groupBy("family", "precision").agg(F.array_join(F.sort_array(F.collect_set("profile")), ",").alias("profiles"))
    costs = routing.costs(files(spark), catalog.measured(spark))
    return costs.join(profiles, ["family", "precision"], "left").select("family", "precision", "license", codes.human_size(F.col("bytes")).alias("size"), F.coalesce("profiles", F.lit("")).alias("profiles"))


# Literals


@query
def tag_counts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit(literals.TAG_PATTERN)).cast("long").alias("n_tags"))


@query
def email_extract(spark, d):
    found = F.regexp_extract_all("text", F.lit(f"({literals.EMAIL_PATTERN})"), 1)
    return docs(spark, d).select("doc_id", F.posexplode(found).alias("i", "email")).select("doc_id", F.col("i").cast("long").alias("i"), "email")


@query
def url_column_rule(spark, d):
    return table(spark, d, "pages").groupBy(content.rule_label(F.col("url")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query
def span_merge(spark, d):
    """Orders of a customer as spans of days; those that overlap become one."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(day.alias("start"), (day + 30).alias("end"))).alias("s"))
    return spans.select("o_custkey", F.explode(literals.merge_spans(F.col("s"))).alias("x")).select("o_custkey", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query
def find_literals(spark, d):
    pages = table(spark, d, "pages").select("page_id", literals.find_literals(F.col("html")).alias("s"))
    return pages.select("page_id", F.explode("s").alias("x")).select("page_id", "x.kind", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), "x.text")


@query
def literal_kind_counts(spark, d):
    found = docs(spark, d).select(F.explode(literals.find_literals(F.col("text"))).alias("x"))
    return found.groupBy(F.col("x.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def find_tags(spark, d):
    pages = table(spark, d, "pages").select("page_id", literals.find_literals(F.col("html"), preserve=["tag"]).alias("s"))
    return pages.select("page_id", F.size("s").cast("long").alias("n_tags"), F.array_join(F.transform("s", lambda x: x.text), "").alias("tags"))


@query
def split_roundtrip(spark, d):
    pages = table(spark, d, "pages").withColumn("s", literals.find_literals(F.col("html")))
    joined = F.array_join(F.transform(literals.pieces(F.col("html"), F.col("s")), lambda p: p.piece), "")
    return pages.select("page_id", F.sha2(joined.cast("binary"), 256).alias("sha"))


@query
def mask_restore_roundtrip(spark, d):
    texts = table(spark, d, "conversations").withColumn("s", literals.find_literals(F.col("text")))
    masked = texts.withColumn("m", literals.mask(F.col("text"), F.col("s")))
    back = F.when(F.col("m").isNull(), F.col("text")).otherwise(literals.restore(F.col("m"), F.col("m.text")))
    return masked.select("conv_id", "turn", (back == F.col("text")).alias("same"))


@query
def literal_retention(spark, d):
    texts = docs(spark, d).withColumn("s", literals.find_literals(F.col("text"), preserve=["email"]))
    with_some = texts.where(F.size("s") > 0)
    return with_some.select(evaluate.literals_kept(F.col("s"), F.lower("text")).alias("kept")).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


# Sentences


@query
def sentence_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(segment.split_sentences(F.col("text")).sentences).cast("long").alias("n_sentences"))


@query
def segment_roundtrip(spark, d):
    cut = docs(spark, d).select("doc_id", segment.split_sentences(F.col("text")).alias("s"))
    back = segment.join_sentences(F.col("s.sentences"), F.col("s.separators"))
    return cut.select("doc_id", F.sha2(back.cast("binary"), 256).alias("sha"))


@query
def distinct_sentences(spark, d):
    found = translate.distinct_sentences(table(spark, d, "conversations").withColumn("id", F.struct("conv_id", "turn")), "id", "text")
    return found.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))


@query
def gather_sentences(spark, d):
    cut = translate.distinct_sentences(docs(spark, d), "doc_id", "text")
    done = cut.select("sentence").distinct().withColumn("translation", F.concat(F.translate("sentence", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("|")))
    return translate.gather_sentences(cut, done, "doc_id").select("doc_id", F.size("sentences").cast("long").alias("n"), F.sha2(F.array_join("sentences", "").cast("binary"), 256).alias("sha"))


# Translation


@query
def translate_toy(spark, d):
    out = translate.Translation(translate.LetterSwap(), "es", preserve=False).translate(table(spark, d, "conversations"), "text", "out", source="en")
    return out.select("conv_id", "turn", "out", F.col("out_status").alias("status"))


@query
def translate_dedupe(spark, d):
    out = translate.Translation(translate.LetterSwap(), "es", preserve=False).translate(table(spark, d, "conversations"), "text", "out", source="en", dedupe=True)
    return out.select("conv_id", "turn", "out", F.col("out_status").alias("status"))


@query
def translate_preserve(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    out = translate.Translation(translate.LetterSwap(), "es", preserve=("url",)).translate(pages.withColumn("text", F.concat(F.lit("see "), "url")), "text", "out", source="en")
    return out.select("page_id", "out", F.col("out_preservation").alias("preservation"))


@query
def translate_errors(spark, d):
    out = translate.Translation(translate.LetterSwap(fail_on="the"), "es", preserve=False).translate(table(spark, d, "conversations"), "text", "out", source="en")
    return out.select("conv_id", "turn", "out", F.col("out_status").alias("status"), F.col("out_error").alias("error"))


@query
def failure_count(spark, d):
    out = translate.Translation(translate.LetterSwap(fail_on="the"), "es", preserve=False).translate(table(spark, d, "conversations"), "text", "out", source="en")
    return out.agg(F.count_if(F.col("out_status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))


@query
def translate_auto_status(spark, d):
    names = {"en": "en", "fr": "fr", "de": "de", "es": "es"}
    swap = translate.LetterSwap(sources=("en", "fr"), targets=("es",))
    found = detected(spark, d, Policy(min_letters=100))
    out = translate.Translation(swap, "es", preserve=False).translate(found, "text", "out", detection=F.col("_detection"), codes=names)
    return out.select("doc_id", F.col("out_status").alias("status"), F.col("out_source").alias("source"))


# Evaluation


@query
def macro_accuracy(spark, d):
    return evaluate.macro_accuracy(detected(spark, d).select("lang", F.col("_detection.language").alias("p")), "lang", "p")


@query
def outcome_by_category(spark, d):
    found = detected(spark, d, Policy(min_letters=100)).select("doc_id", F.col("_detection.language").alias("p"), F.concat("lang", F.lit("|xx")).alias("want"))
    rows = found.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.outcomes(rows, "source", "want", "p")


@query
def short_text_accuracy(spark, d):
    """Texts cut to 40 characters, as short-text evaluation does, under the model of whole texts."""
    short = docs(spark, d).withColumn("text", F.substring("text", 1, 40))
    found = LanguageDetection(NgramDetector(model(spark, d))).detect(short, "doc_id", "text")
    return evaluate.macro_accuracy(found.select("lang", F.col("_detection.language").alias("p")), "lang", "p")


@query
def first_n_per_lang(spark, d):
    return evaluate.first_per_group(docs(spark, d), "lang", "doc_id", 25).select("lang", "doc_id")


@query
def known_to_all_models(spark, d):
    labels = catalog.model_languages(spark, language_codes()).where("side = 'target'").select("family", "code")
    return evaluate.known_to_all(labels, "family", "code")


@query
def unknown_candidates(spark, d):
    wanted = docs(spark, d).select(F.col("lang").alias("code")).distinct().unionAll(spark.createDataFrame([("xx",), ("tlh",)], "code string"))
    return wanted.join(codes.languages(spark), "code", "left_anti")
