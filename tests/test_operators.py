import pytest
from pyspark.sql import functions as F

from verbaloom.operators import evaluate, ngram_model, translate
from verbaloom.operators.detect import BatchDetector, LanguageDetection, NgramDetector, Policy


def fixed_scores():
    table = {"clear winner": [("en", 0.9), ("fr", 0.05)], "weak one here": [("en", 0.3), ("fr", 0.1)], "close call here": [("en", 0.5), ("fr", 0.49)], "no answer here": []}
    return lambda texts: [table.get(t, [("und", 1.0)]) for t in texts]


def test_policy_order(spark):
    texts = [None, "", "12 34", "ab", "clear winner", "weak one here", "close call here", "no answer here"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = LanguageDetection(BatchDetector(fixed_scores, ("en", "fr")), Policy(min_letters=4, min_score=0.4, min_margin=0.1)).detect(df, "id", "text")
    got = {r.id: (r["_detection"].language, r["_detection"].status) for r in found.collect()}
    assert got == {0: ("und", "empty"), 1: ("und", "empty"), 2: ("zxx", "non_linguistic"), 3: ("und", "insufficient_text"), 4: ("en", "detected"), 5: ("und", "low_confidence"), 6: ("und", "ambiguous"), 7: ("und", "low_confidence")}
    kept = LanguageDetection(BatchDetector(fixed_scores, ("en", "fr")), Policy(candidates=("fr",))).detect(df, "id", "text")
    assert {r.id: r["_detection"].score for r in kept.collect()}[6] == 0.49


def test_policy_arguments():
    for bad in ({"min_letters": 0}, {"min_letters": True}, {"min_score": -1}, {"candidates": "en"}, {"candidates": ()}):
        with pytest.raises(ValueError):
            Policy(**bad)
    with pytest.raises(ValueError):
        LanguageDetection(BatchDetector(fixed_scores, ("en",)), Policy(candidates=("tlh",)))


def test_model_sees_only_what_it_has_to(spark, tmp_path):
    log = str(tmp_path / "seen")

    def recording():
        def predict(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[("en", 1.0)] for _ in texts]

        return predict

    df = spark.createDataFrame([(0, ""), (1, "12"), (2, "ab"), (3, "some words")], "id long, text string")
    LanguageDetection(BatchDetector(recording), Policy(min_letters=4)).detect(df, "id", "text").collect()
    assert set(open(log).read().split("\n")) - {""} == {"some words"}


def test_ngram_model_agrees_with_plain_python(spark, data):
    from collections import Counter
    from math import log

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    grams = {r.doc_id: Counter(r.text.lower()[i : i + 3] for i in range(len(r.text.lower()) - 2)) for r in rows}
    langs = sorted({r.lang for r in rows})
    by = {x: sum((grams[r.doc_id] for r in rows if r.lang == x), Counter()) for x in langs}
    vocabulary = set().union(*by.values())
    total = {x: sum(by[x].values()) for x in langs}
    prior = {x: log(sum(r.lang == x for r in rows) / len(rows)) for x in langs}
    model = ngram_model.train(docs, "text", "lang")
    got = {(r.doc_id, r.language): r.score for r in model.scores(docs, "doc_id", "text").collect()}
    for r in rows[:40]:
        for x in langs:
            want = prior[x] + sum(n * log((by[x][g] + 1) / (total[x] + len(vocabulary))) for g, n in grams[r.doc_id].items())
            assert abs(got[r.doc_id, x] - want) < 1e-6 * max(1, abs(want))


def test_partitions_do_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = ngram_model.train(docs, "text", "lang")
    joined = ngram_model.train(docs, "text", "lang", max_cells=0)
    assert joined.arrays is None and model.arrays is not None
    a, b = ({(r.doc_id, r.language): r.score for r in m.scores(docs, "doc_id", "text").collect()} for m in (model, joined))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * max(1, abs(a[k])) for k in a)
    assert {(r.gram, round(r.logp, 9)) for r in model.table.collect()} == {(r.gram, round(r.logp, 9)) for r in joined.table.collect()}
    joined.release()
    odd = spark.createDataFrame([(1, "the house", "x"), (1, None, "y"), (None, "und das Haus", "z"), (None, "", "w")], "id long, text string, _rule string").withColumns({"_letters": F.lit(1), "_asked": F.lit(2)})
    out = LanguageDetection(NgramDetector(model), Policy(min_letters=2)).with_language(odd, "id", "text", "l", detailed=True).collect()
    assert sorted((r._rule, r._letters, r._asked, r.l.status) for r in out) == [("w", 1, 2, "empty"), ("x", 1, 2, "detected"), ("y", 1, 2, "empty"), ("z", 1, 2, "detected")]
    found = [sorted((r.doc_id, r.l) for r in LanguageDetection(NgramDetector(model)).with_language(docs.repartition(n), "doc_id", "text", "l").select("doc_id", "l").collect()) for n in (1, 5)]
    assert found[0] == found[1]
    accuracy = docs.join(spark.createDataFrame(found[0], "doc_id long, l string"), "doc_id").agg(F.avg((F.col("lang") == F.col("l")).cast("int"))).first()[0]
    assert accuracy > 0.95


def test_empty_training(spark):
    model = ngram_model.train(spark.createDataFrame([], "text string, lang string"), "text", "lang")
    assert model.languages == ()
    with pytest.raises(ValueError):
        model.scores(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")


def test_translation_statuses(spark):
    rows = [(0, None, "en"), (1, " ", "und"), (2, "hola", "es"), (3, "hello there", "en"), (4, "???", "zxx"), (5, "hmm", "und"), (6, "hallo", "de"), (7, "bad hello", "en")]
    df = spark.createDataFrame(rows, "id long, text string, l string").withColumn("d", F.struct(F.col("l").alias("language")))
    model = translate.LetterSwap(sources=("en", "fr"), targets=("es",), fail_on="bad")
    out = translate.Translation(model, "es").translate(df, "text", "out", detection=F.col("d"), codes={"en": "en", "es": "es", "de": "de"})
    got = {r.id: (r.out, r.out_status) for r in out.collect()}
    assert got == {0: (None, None), 1: (" ", "unchanged"), 2: ("hola", "unchanged"), 3: ("HELLO THERE:es", "translated"), 4: ("???", "unchanged"), 5: ("hmm", "unknown_source"), 6: ("hallo", "unsupported_source"), 7: (None, "failed")}
    errors = {r.id: r.out_error for r in out.collect()}
    assert errors[7].startswith("RuntimeError: ") and errors[3] is None
    with pytest.raises(Exception, match="no source language"):
        translate.Translation(model, "es", unknown_source="raise").translate(df, "text", "out", detection=F.col("d"), codes={"en": "en"}, id_col="id").collect()
    with pytest.raises(ValueError):
        translate.Translation(model, "es").translate(df, "text", "out", source="zh")


class Echo(translate.LetterSwap):
    def translate(self, texts, source, target):
        return [t.replace("hello", "hola") for t in texts]


def test_literals_survive(spark):
    df = spark.createDataFrame([("hello https://site.org/hello",), ("zxq qzx hello 12",)], "text string")
    out = translate.Translation(Echo(), "es").translate(df, "text", "out", source="en").collect()
    assert [(r.out, r.out_preservation) for r in out] == [("hola https://site.org/hello", "placeholders"), ("zxq qzx hola 12", "segments")]


def test_literals_kept(spark):
    df = spark.createDataFrame([("a@b.cd x a@b.cd", "a@b.cd"), ("a@b.cd", "see a@b.cd")], "text string, out string")
    from verbaloom.functions import literals

    got = df.withColumn("s", literals.find_literals(F.col("text"))).select(evaluate.literals_kept(F.col("s"), F.col("out")).alias("k")).collect()
    assert [r.k for r in got] == [False, True]
