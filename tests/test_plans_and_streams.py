import json

import pytest
from pyspark.sql import functions as F

from verbaloom import queries
from verbaloom.operators import ngram_model
from verbaloom.operators.detect import BatchDetector, LanguageDetection, NgramDetector
from verbaloom.plans import catalog, routing
from verbaloom.sources import text_lines
from verbaloom.streaming import streams


def route(spark, profile, source, target, **limits):
    requests = spark.createDataFrame([(profile, source, target)], "profile string, source string, target string")
    found = routing.candidates(requests, catalog.rules(spark), catalog.pairs(spark), catalog.model_languages(spark, queries.language_codes()))
    costs = routing.costs(queries.files(spark), catalog.measured(spark)) if limits else None
    rows = routing.choose(found, costs, **limits).collect()
    return (rows[0].family, rows[0].precision) if rows else None


def test_routes(spark):
    assert route(spark, "speed", "en", "de") == ("pair", "q4")
    assert route(spark, "quality", "en", "de") == ("pair", "fp32")
    assert route(spark, "quality", "en", "de", limit=300 << 20) == ("pair", "q4")
    assert route(spark, "balance", "bo", "en") == ("large", "int8")
    assert route(spark, "balance", "bo", "en", allowed=["MIT"]) == ("small", "int8")
    assert route(spark, "balance", None, "en") == ("small", "int8")
    assert route(spark, "speed", "en", "bo") is None
    assert route(spark, "balance", "en", "br") == ("small", "int8")
    assert len(catalog.PAIRS) == 66 and len(queries.language_codes()) == 198
    with pytest.raises(TypeError):
        routing.rejection(F.lit("MIT"), F.lit(1), "MIT")
    with pytest.raises(ValueError):
        routing.rejection(F.lit("MIT"), F.lit(1), None, -1)


def vowels():
    return lambda texts: [[("a", t.count("a") / (len(t) or 1)), ("b", 0.01)] for t in texts]


def test_stream_equals_batch(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_rows(spark, str(tmp_path / "in"), "doc_id long, text string")
    labelled = spark.read.parquet(f"{data}/documents.parquet")
    for name, detector in (("batch", BatchDetector(vowels)), ("trigrams", NgramDetector(ngram_model.train(labelled, "text", "lang")))):
        detection, out = LanguageDetection(detector), str(tmp_path / f"out-{name}")
        streams.run_once(streams.detect_stream(stream, "doc_id", "text", detection).select("doc_id", F.col("_detection.language").alias("l")), lambda df, _, out=out: df.write.mode("append").parquet(out), str(tmp_path / f"c1-{name}"))
        batch = detection.detect(docs, "doc_id", "text").select("doc_id", F.col("_detection.language").alias("l"))
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))
    counts: dict = {}
    labels = streams.with_rule_label(streams.read_rows(spark, str(tmp_path / "in"), "doc_id long, text string"), "text").withColumn("rule", F.coalesce("rule", F.lit("text")))
    streams.run_once(streams.label_counts(labels, "rule"), lambda df, _: counts.update({r.rule: r.n for r in df.collect()}), str(tmp_path / "c2"), "complete")
    assert sum(counts.values()) == docs.count()
    with pytest.raises(TypeError):
        streams.detect_stream(stream, "doc_id", "text", LanguageDetection(object()))


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\n\nthrée".encode())
    lines = text_lines.read_lines(spark, str(tmp_path / "a.txt"))
    assert [r.text for r in lines.collect()] == ["one", "two", "", "thrée"]
    line = text_lines.json_lines(spark.createDataFrame([("x", None)], "t string, l string"), {"text": "t", "language": "l"}).first().value
    assert json.loads(line) == {"text": "x", "language": None}
    text_lines.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string"), "i", "t", str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a", "b"]
    (tmp_path / "cache/m1").mkdir(parents=True)
    (tmp_path / "cache/m1/w.bin").write_bytes(b"12345")
    assert [tuple(r) for r in text_lines.inventory(spark, str(tmp_path / "cache")).collect()] == [("m1", 1, 5)]


def test_queries_against_sql(spark, data):
    import duckdb

    from verbaloom import oracles

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "orders", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("rule_label", "letter_count", "to_language", "macro_collapse", "nb_top1", "detect_candidates", "route_constrained", "plan_totals", "span_merge", "find_tags", "sentence_counts", "translate_preserve"):
        got = queries.QUERIES[name](spark, data)
        want = c.execute(oracles.ORACLES[name])
        names = [x[0] for x in want.description]
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall())), name


def test_batch_model_ties_and_halves(spark, tmp_path):
    """Texts of as many vowels as other characters, and shares that end in a half of the last digit kept."""
    import duckdb

    from verbaloom import oracles

    shares = [(2, 4), (400, 800), (81, 800), (131, 800), (323, 800), (427, 800), (477, 800), (5, 8), (0, 6), (6, 6)]
    texts = ["a" * k + "b" * (n - k) for k, n in shares] + ["ab", "", None]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute("SELECT doc_id, language, score FROM (" + oracles.ORACLES["detect_batch_model"] + ")").fetchall())
    assert sorted(map(tuple, queries.QUERIES["detect_batch_model"](spark, str(tmp_path)).collect())) == want
    assert [x[1:] for x in want[:4]] == [("con", 0.5), ("con", 0.5), ("con", 0.8988), ("con", 0.8363)]
