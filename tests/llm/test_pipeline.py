import zlib

import numpy as np
import plain
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from verbaloom.llm import quality


def test_pipeline_equals_plain_version(spark, data):
    """Each stage by definition; the quality verdicts come from SQL, as they rest on corpus statistics."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    from verbaloom.llm import oracles

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rows = c.execute(f"WITH {oracles.op4_features()} SELECT doc_id, documents.text FROM j JOIN documents USING (doc_id) WHERE coalesce(kept, NOT base_failed)").fetchall()
    rows = [(i, x[3]) for i, x in plain.lines(rows).items() if x[1] == 0 or x[1] < x[0]]
    linked = plain.components(rows)
    rows = [(i, t) for i, t in rows if linked[i][1] == i]
    met = plain.contamination(rows, c.execute("SELECT item_id, text FROM benchmark").fetchall())
    rows = [(i, t) for i, t in rows if not met[i][2]]  # any item met: the document is affected
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want |= {(i, p, min(4096, len(ids) - 4096 * p), zlib.crc32(ids[4096 * p : 4096 * (p + 1)].tobytes())) for p in range(-(-len(ids) // 4096))}
    out = pipeline.run(spark, data)
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in out.collect()} == want
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("__row", F.lit("clash"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), data).isEmpty(), name
    assert quality.keep_good(docs).where("doc_id IS NULL").isEmpty()
