import base64
import bz2
import io
import pickle
import struct
import tarfile

import numpy as np
import pytest

from verbaloom import cli
from verbaloom.operators import seq2seq
from verbaloom.operators.detect import BatchDetector, LanguageDetection
from verbaloom.operators.translate import LetterSwap, Outcome, Translation
from verbaloom.sources import fasttext_file, langid_file

WORDS = ["the", "of", "der", "und"]


def write_fasttext(path, loss=3, maxn=3, word_ngrams=2, dim=4, bucket=16, version=12, model=3):
    rng = np.random.default_rng(5)
    labels = ["__label__en", "__label__de", "__label__fr"]
    inputs = rng.normal(size=(len(WORDS) + 1 + bucket, dim)).astype("<f4")
    outputs = rng.normal(size=(3, dim)).astype("<f4")
    with open(path, "wb") as f:
        f.write(struct.pack("<ii12id", 793712314, version, dim, 5, 5, 1, 5, word_ngrams, loss, model, bucket, 2, maxn, 100, 1e-4))
        f.write(struct.pack("<iiiqq", len(WORDS) + 1 + 3, len(WORDS) + 1, 3, 100, -1))
        for w in ["</s>", *WORDS]:
            f.write(w.encode() + b"\0" + struct.pack("<qb", 10, 0))
        for i, x in enumerate(labels):
            f.write(x.encode() + b"\0" + struct.pack("<qb", 9 - 3 * i, 1))
        f.write(struct.pack("<?qq", False, *inputs.shape) + inputs.tobytes())
        f.write(struct.pack("<?qq", False, *outputs.shape) + outputs.tobytes())
    return inputs, outputs


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = ((h ^ (b - 256 if b > 127 else b)) & 0xFFFFFFFF) * 16777619 % 2**32
    return h


def test_fasttext_scores(tmp_path):
    path = str(tmp_path / "m.bin")
    inputs, outputs = write_fasttext(path)
    model = fasttext_file.FastText(path)
    words = ["the", "né", "</s>"]
    ids = []
    for w in words:
        ids += [[*["</s>"], *WORDS].index(w)] if w in ["</s>", *WORDS] else []
        if w != "</s>":
            m = f"<{w}>"
            ids += [5 + fnv(m[i : i + n]) % 16 for i in range(len(m)) for n in (2, 3) if i + n <= len(m)]
    signed = [h - 2**32 if (h := fnv(w)) >= 2**31 else h for w in words]
    ids += [5 + ((signed[i] % 2**64 * 116049371 + signed[i + 1]) % 2**64) % 16 for i in range(2)]
    logits = outputs @ inputs[ids].mean(axis=0)
    want = np.exp(logits) / np.exp(logits).sum()
    got = model.predict(["the\nné"])[0]
    assert [x for x, _ in got] == ["en", "de", "fr"]
    assert np.allclose([s for _, s in got], want, atol=1e-6)
    for loss in (1, 2, 4):
        write_fasttext(path, loss=loss)
        scores = [s for _, s in fasttext_file.FastText(path).predict(["the of"])[0]]
        assert all(0 <= s <= 1 for s in scores) and (loss != 1 or abs(sum(scores) - 1) < 1e-3)
    for bad in ({"version": 13}, {"model": 1}):
        write_fasttext(path, **bad)
        with pytest.raises(ValueError):
            fasttext_file.FastText(path)
    (tmp_path / "x.bin").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError):
        fasttext_file.FastText(str(tmp_path / "x.bin"))


def test_huffman_paths():
    ones, zeros = fasttext_file.tree_paths(np.array([40, 20, 10, 5]))
    assert (ones + zeros).sum(axis=1).tolist() == [1, 2, 3, 3]


def test_fasttext_in_spark(spark, tmp_path):
    path = str(tmp_path / "m.bin")
    write_fasttext(path)
    df = spark.createDataFrame([(1, "the of and"), (2, ""), (3, "der und")], "id long, text string")
    got = LanguageDetection(BatchDetector(fasttext_file.opener(path))).with_language(df, "id", "text", "l", with_score=True, status_col="s").collect()
    plain = fasttext_file.FastText(path)
    for r in got:
        if r.s == "detected":
            best = max(plain.predict([r.text])[0], key=lambda x: x[1])
            assert (r.l[0].language, round(r.l[0].score, 6)) == (best[0], round(best[1], 6)) and len(r.l) == 3
        else:
            assert r.s == "empty" and r.l[0].language == "und"


def langid_source(tmp_path, archive):
    from array import array

    moves = array("H", [1 if c == ord("a") else 2 if c == ord("b") else 0 for _ in range(3) for c in range(256)])
    model = (array("d", [-1.0, -3.0, -2.5, -0.5]), array("d", [-0.7, -0.6]), ["aa", "bb"], moves, {1: (0,), 2: (1,)})
    text = b'model=b"""' + base64.b64encode(bz2.compress(pickle.dumps(model, 2))) + b'"""\n'
    path = tmp_path / ("m.tar.gz" if archive else "langid.py")
    if archive:
        with tarfile.open(path, "w:gz") as t:
            info = tarfile.TarInfo("pkg/langid.py")
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    else:
        path.write_bytes(text)
    return str(path)


@pytest.mark.parametrize("archive", [False, True])
def test_langid(tmp_path, archive):
    model = langid_file.ByteBayes(langid_source(tmp_path, archive))
    for text, got in zip(["aab", "b", "", "xyz"], model.predict(["aab", "b", "", "xyz"]), strict=True):
        a, b = text.count("a"), text.count("b")
        s = np.array([-0.7 - a - 2.5 * b, -0.6 - 3 * a - 0.5 * b])
        assert np.allclose([x for _, x in got], np.exp(s) / np.exp(s).sum())
    assert langid_file.ByteBayes(langid_source(tmp_path, archive), ("aa",)).predict(["b"]) == [[("aa", 1.0)]]
    with pytest.raises(ValueError):
        langid_file.ByteBayes(langid_source(tmp_path, archive), ("zz",))
    with pytest.raises(pickle.UnpicklingError):
        langid_file.Strict(io.BytesIO(pickle.dumps(print))).load()


class Letters(seq2seq.Decoder):
    """Tokens are letters; the next token is the input's next letter in upper case. A tilde never ends."""

    start, end, limit = 1, 0, 24

    def tokenize(self, text):
        return [ord(c) for c in text], [(i, i + 1) for i in range(len(text))]

    def text(self, ids):
        return "".join(map(chr, ids))

    def banned(self):
        return (ord("Q"),)

    def encode(self, ids, mask):
        return ids

    def scores(self, memory, rows, prefix):
        out = np.zeros((len(rows), 500))
        at = prefix.shape[1] - 1
        for k, r in enumerate(rows):
            ids = memory[r]
            endless = (ids == ord("~")).any()
            token = ids[at] if at < len(ids) else 0
            out[k, ord("~") if endless and token == 0 else ord(chr(token).upper()) if token else 0] = 1
        return out


def test_greedy_translation():
    model = seq2seq.Seq2Seq(Letters(), "letters", batch_size=2)
    assert model.translate(["ab. Cd. ab.", "", " x\ny "], "en", "es") == ["AB. CD. AB.", "", " X\nY "]
    with pytest.raises(seq2seq.InputTooLong):
        model.translate(["a" * 60], "en", "es")
    cut = seq2seq.Seq2Seq(Letters(), "letters", truncate=True).outcomes(["a" * 60], "en", "es")[0]
    assert cut.truncated and cut.text == "A" * 23
    split = seq2seq.Seq2Seq(Letters(), "letters", split_long=True).outcomes(["word, " * 9 + "end"], "en", "es")[0]
    assert split.split and split.text == "WORD, " * 9 + "END"
    assert seq2seq.Seq2Seq(Letters(), "letters").outcomes(["a~"], "en", "es")[0].limit_reached


@pytest.mark.parametrize("preserve", [False, True])
@pytest.mark.parametrize("dedupe", [False, True])
def test_flags_reach_the_columns(spark, preserve, dedupe):
    long, endless, clauses = "a" * 60, "a~", "word, " * 9 + "end"
    texts = [None, " ", "ab.", long, endless, clauses, f"{long} https://site.org/x", f"12 {endless}", f"zxq qzx https://site.org/x {long}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    flags = ("out_input_truncated", "out_output_limit_reached", "out_input_split")

    def run(**options):
        model = seq2seq.Seq2Seq(Letters(), "letters", **options)
        out = Translation(model, "es", preserve=preserve).translate(df, "text", "out", source="en", dedupe=dedupe)
        return {r.id: (r.out_status, *[r[f] for f in flags]) for r in out.collect()}

    cut, split, plain = run(truncate=True), run(split_long=True), run()
    assert cut[0] == (None, None, None, None) and cut[1] == ("unchanged", False, False, False)
    assert cut[2] == ("translated", False, False, False) and cut[3] == ("translated", True, False, False)
    assert cut[4] == ("translated", False, True, False) and split[5] == ("translated", False, False, True)
    assert cut[6][1] and cut[7][2] and cut[8][1] and plain[3] == ("failed", False, False, False)


def test_flags_survive_placeholders(spark):
    class Flagged(LetterSwap):
        def outcomes(self, texts, source, target):
            return [Outcome(t, truncated=True, split=True) for t in texts]

    out = Translation(Flagged(), "es").translate(spark.createDataFrame([("see https://site.org/x",)], "text string"), "text", "out", source="en").first()
    assert (out.out, out.out_preservation) == ("see https://site.org/x", "placeholders")
    assert (out.out_input_truncated, out.out_output_limit_reached, out.out_input_split) == (True, False, True)


def test_cli(spark, data, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("the house of the river and the morning\n\n12 34\n")
    assert cli.run(spark, ["detect", str(tmp_path / "in.txt"), "--train", f"{data}/documents.parquet"]) == 0
    assert capsys.readouterr().out.split("\n") == ["en", "und", "zxx", ""]
    assert cli.run(spark, ["detect", str(tmp_path / "in.txt"), "--train", f"{data}/documents.parquet", "--json", "--min-letters", "4"]) == 0
    assert '"status":"empty"' in capsys.readouterr().out
    assert cli.run(spark, ["translate", str(tmp_path / "in.txt"), "--to", "es", "--from", "en", "--keep", "river"]) == 0
    assert capsys.readouterr().out.startswith("THE HOUSE OF THE:es river AND")
    assert cli.run(spark, ["plan", "--pair", "en:de"]) == 0 and "pair" in capsys.readouterr().out
    assert cli.run(spark, ["list"]) == 0
    with pytest.raises(ValueError):
        cli.run(spark, ["detect", str(tmp_path / "in.txt")])


def test_onnx_pieces():
    from verbaloom.operators import onnx_classifier as o

    assert np.allclose(o.softmax(np.array([[0.0, 0.0], [1e3, 0.0]])), [[0.5, 0.5], [1, 0]])
    assert o.shortened("a b" * 10, 100) == "a b" * 10
    assert o.shortened("word " * 10, 2) == "word word word"[:14]
    assert o.shortened("x" * 50, 2) == "x" * 16
