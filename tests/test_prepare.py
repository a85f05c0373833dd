import hashlib

import pytest

from verbaloom import queries
from verbaloom.operators.translate import LetterSwap, Translation
from verbaloom.plans import prepare
from verbaloom.sources import weights
from verbaloom.streaming import streams


def test_cache_location(tmp_path, monkeypatch):
    monkeypatch.setenv("VERBALOOM_CACHE", str(tmp_path / "env"))
    assert weights.cache_dir("/x") == weights.Path("/x") and weights.cache_dir() == tmp_path / "env"
    (tmp_path / "env" / "m").mkdir(parents=True)
    assert weights.resolve("m") == tmp_path / "env" / "m"
    with pytest.raises(FileNotFoundError):
        weights.resolve("other")
    monkeypatch.delenv("VERBALOOM_CACHE")
    assert weights.cache_dir().name == "verbaloom"


def test_fetch(tmp_path):
    source = tmp_path / "source.bin"
    source.write_bytes(b"weights" * 1000)
    good = hashlib.sha256(source.read_bytes()).hexdigest()
    target = weights.fetch(source.as_uri(), tmp_path / "c" / "m" / "w.bin", good)
    assert target.read_bytes() == source.read_bytes()
    source.write_bytes(b"new")
    assert weights.fetch(source.as_uri(), target).stat().st_size == 7000
    with pytest.raises(ValueError):
        weights.fetch(source.as_uri(), target, good, force=True)
    assert target.stat().st_size == 7000
    with pytest.raises(OSError):
        weights.fetch((tmp_path / "none").as_uri(), tmp_path / "n", wait=0)


def test_present_files(spark, tmp_path):
    assert weights.present_files(spark, tmp_path / "no").isEmpty()
    (tmp_path / "m/sub").mkdir(parents=True)
    (tmp_path / "m/sub/w.bin").write_bytes(b"123")
    assert [tuple(r) for r in weights.present_files(spark, tmp_path).collect()] == [("m", "sub/w.bin", 3)]


def test_plans(spark):
    files = queries.files(spark)
    present = files.where("family = 'pair'").select("family", "precision", "file")
    rows = prepare.plan(spark, "balance", [("en", "de"), ("de", "en"), ("bo", "en"), ("auto", "fr")], files, present).collect()
    assert {(r.family, r.precision, r.cached) for r in rows} == {("pair", "q4", True), ("large", "int8", False), ("small", "int8", False)}
    with pytest.raises(prepare.Constrained):
        prepare.plan(spark, "balance", [("bo", "en")], files, present, allowed=["Apache-2.0"])
    with pytest.raises(prepare.Unsupported):
        prepare.plan(spark, "speed", [("en", "bo")], files, present)
    with pytest.raises(prepare.Unsupported):
        prepare.plan(spark, "speed", [("en", "klingon")], files, present)


def test_translation_checks_come_first(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    for model, source, target, word in ((LetterSwap(targets=("es",)), "en", "de", "write"), (LetterSwap(sources=("en", "fr")), None, "de", "know"), (LetterSwap(sources=("en",)), "fr", "de", "read")):
        with pytest.raises(ValueError, match=word):
            Translation(model, target).translate(df, "text", "out", source=source)
    same = Translation(LetterSwap(targets=("es",)), "de").translate(df, "text", "out", source="de").first()
    assert (same.out, same.out_status) == ("a b", "unchanged")


def test_translated_stream_equals_batch(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "text")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streams.read_rows(spark, str(tmp_path / "in"), "conv_id long, turn long, text string")
    work = Translation(LetterSwap(fail_on="the"), "es")
    out = str(tmp_path / "out")
    streams.run_once(streams.translate_stream(stream, "text", "out", work, source="en"), lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "c"))
    same = lambda df: sorted(repr(tuple(r)) for r in df.select("conv_id", "turn", "out", "out_status").collect())
    assert same(spark.read.parquet(out)) == same(work.translate(rows, "text", "out", source="en"))
    with pytest.raises(ValueError):
        streams.translate_stream(stream, "text", "out", work, source="en", dedupe=True)
