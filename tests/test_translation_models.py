import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaloom import cli
from verbaloom.functions import register
from verbaloom.operators import backends, detect, evaluate, model_pool, onnx_seq2seq
from verbaloom.operators.translate import LetterSwap, RoutedTranslator, Translation
from verbaloom.plans import catalog
from verbaloom.streaming import streams


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """Protobuf: numbers as varints, all else with its length."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def tensor(name, x):
    kind = 1 if x.dtype == np.float32 else 7
    return message(*[(1, d) for d in x.shape], (2, kind), (8, name), (9, x.tobytes()))


def value(name, kind, dims):
    shape = message(*[(1, message((1, d) if isinstance(d, int) else (2, d))) for d in dims])
    return message((1, name), (2, message((1, message((1, kind), (2, shape))))))


def node(op, inputs, outputs, **attributes):
    own = [message((1, k), (3, v), (20, 2)) if isinstance(v, int) else message((1, k), *[(8, x) for x in v], (20, 7)) for k, v in attributes.items()]
    return message(*[(1, x) for x in inputs], *[(2, x) for x in outputs], (4, op), *[(5, x) for x in own])


def model(path, nodes, inputs, outputs, tensors):
    graph = message(*[(1, n) for n in nodes], (2, "g"), *[(5, tensor(k, v)) for k, v in tensors.items()], *[(11, v) for v in inputs], *[(12, v) for v in outputs])
    path.write_bytes(message((1, 8), (7, graph), (8, message((1, ""), (2, 13)))))


VOCABULARY = ["<s>", "</s>", "<pad>", "<unk>", "__en__", "__es__", "eng_Latn", "spa_Latn", ">>es<<", "one", "two", "three", "uno", "dos"]
V, H = len(VOCABULARY), 3
FLOAT, LONG = 1, 7


def tables():
    rng = np.random.default_rng(3)
    return {k: rng.normal(size=s).astype(np.float32) for k, s in (("E", (V, H)), ("W", (V, V)), ("U", (H, V)), ("R", (V,)))}


def write_folder(folder, family, precision="fp32", cached=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder.mkdir(exist_ok=True)
    t = tables()
    names = catalog.model_files(family, precision)
    axis = lambda *x: np.array(x, dtype=np.int64)
    model(
        folder / names[0],
        [node("Gather", ["E", "input_ids"], ["e"]), node("Cast", ["attention_mask"], ["m"], to=FLOAT), node("Unsqueeze", ["m", "two"], ["m3"]), node("Mul", ["e", "m3"], ["hidden"])],
        [value("input_ids", LONG, ["b", "s"]), value("attention_mask", LONG, ["b", "s"])], [value("hidden", FLOAT, ["b", "s", H])], {"E": t["E"], "two": axis(2)},
    )
    # What comes next depends on the last token, on the whole input and on the sum of all tokens so far.
    past = ["past_key_values.0.decoder.key"] * cached
    model(
        folder / names[1],
        [
            node("Cast", ["input_ids"], ["f"], to=FLOAT), node("Unsqueeze", ["f", "one_three"], ["f4"]),
            *([node("Concat", [*past, "f4"], ["present.0.decoder.key"], axis=2)] if cached else [node("Identity", ["f4"], ["present.0.decoder.key"])]),
            node("ReduceSum", ["present.0.decoder.key", "one_two_three"], ["s"]), node("Squeeze", ["s", "three"], ["s3"]), node("Mul", ["s3", "R"], ["r"]),
            node("ReduceSum", ["encoder_hidden_states", "one"], ["h"]), node("MatMul", ["h", "U"], ["u"]), node("Gather", ["W", "input_ids"], ["w"]),
            node("Add", ["w", "u"], ["wu"]), node("Add", ["wu", "r"], ["logits"]),
        ],
        [value("input_ids", LONG, ["b", "t"]), value("encoder_hidden_states", FLOAT, ["b", "s", H]), *[value(x, FLOAT, ["b", 1, "p", 1]) for x in past]],
        [value("logits", FLOAT, ["b", "t", V]), value("present.0.decoder.key", FLOAT, ["b", 1, "q", 1])],
        {"W": t["W"], "U": t["U"], "R": t["R"], "one": axis(1), "three": axis(3), "one_three": axis(1, 3), "one_two_three": axis(1, 2, 3)},
    )
    tokenizer = Tokenizer(models.WordLevel({x: i for i, x in enumerate(VOCABULARY)}, unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tokenizer.add_special_tokens(VOCABULARY[:3])
    tokenizer.save(str(folder / "tokenizer.json"))
    (folder / "config.json").write_text(json.dumps({"decoder_start_token_id": 0, "eos_token_id": 1, "max_length": 16, "target_prefix": family == "pair"}))
    return str(folder)


def plain(ids, forced, banned):
    """Greedy decoding by definition."""
    t, out = tables(), [0]
    budget = min(16, 2 * len(ids) + 10)
    for step in range(budget):
        scores = t["W"][out[-1]] + t["E"][ids].sum(axis=0) @ t["U"] + np.float32(sum(out)) * t["R"]
        scores[list(banned)] = -np.inf
        nxt = forced if step == 0 and forced is not None else int(scores.argmax())
        if nxt == 1:
            break
        out.append(nxt)
    return out[1 + (forced is not None) :]


@pytest.mark.parametrize("cached", [True, False])
@pytest.mark.parametrize("family", ["pair", "medium", "small", "large"])
def test_families_decode_as_defined(tmp_path, family, cached):
    folder = write_folder(tmp_path / "m", family, cached=cached)
    index = {x: i for i, x in enumerate(VOCABULARY)}
    words = lambda s: [index[w] for w in s.split()]
    frames = {"pair": lambda s: [8, *words(s), 1], "medium": lambda s: [4, *words(s), 1], "small": lambda s: [5, *words(s), 1], "large": lambda s: [6, *words(s), 1]}
    forced = {"medium": 5, "large": 7}.get(family)
    banned = (2,) if family == "pair" else ()
    texts = ["one", "two three", "three one two", "one two three one two"]
    translator = onnx_seq2seq.onnx_translator(folder, family, sources=("en",), targets=("es",))
    d = translator.decoder
    assert d is translator.decoder and d.frame(words("one"), "en", "es") == frames[family]("one") and d.forced("es") == forced and d.banned() == banned
    got = translator.translate(texts, "en", "es")
    for t, g in zip(texts, got, strict=True):
        assert g == d.text(plain(frames[family](t), forced, banned)).strip(), t
    assert translator.supports(None, "es") or family != "small"
    if family in ("medium", "large"):
        with pytest.raises(ValueError):
            d.frame([9], "xx", "es")
    with pytest.raises(FileNotFoundError):
        onnx_seq2seq.OnnxDecoder(folder, family, "q4")
    model_pool.worker_pool().unload()


def test_invalid_merges_are_left_out():
    settings = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b", "a c", "b a"]}}
    assert onnx_seq2seq.checked_tokenizer(json.dumps(settings), True).encode("ab").ids == [2]
    with pytest.raises(Exception):  # noqa: B017
        onnx_seq2seq.checked_tokenizer(json.dumps(settings), False)


def test_pool_evicts_before_it_loads():
    log = []
    pool = model_pool.ModelPool(2)
    for key in "abacb":
        pool.get(key, lambda key=key: log.append((key, pool.loaded)) or key)
    assert log == [("a", ()), ("b", ("a",)), ("c", ("a",)), ("b", ("c",))] and pool.loaded == ("c", "b")
    pool.unload()
    assert pool.loaded == ()
    for bad in (0, True, "2"):
        with pytest.raises(ValueError):
            model_pool.ModelPool(bad)


def named(name):
    class Named(LetterSwap):
        def translate(self, texts, source, target):
            return [f"{name}({t})" for t in texts]

    return lambda: Named()


def test_sources_choose_models(spark):
    routed = RoutedTranslator({"en": "A", "de": "B", "fr": "A", None: "C"}, {x: named(x) for x in "ABC"}, ("es",))
    rows = [(0, "eng", "one", 0.9), (1, "deu", "zwei", 0.8), (2, "fra", "trois", 0.7), (3, "und", "hm hm", None), (4, "spa", "uno", 0.9), (5, "zxx", "12", None), (6, "tlh", "nuq", 0.6), (7, "und", " ", None), (8, None, None, None)]
    df = spark.createDataFrame(rows, "id long, language string, text string, score double").withColumn("d", F.struct("language", "score"))
    part3 = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "tlh": "tlh"}
    for unknown, by_model in (("keep", None), ("fallback", 3)):
        out = Translation(routed, "es", preserve=False, unknown_source=unknown).translate(df, "text", "out", detection=F.col("d"), codes=part3, by_model=by_model)
        got = {r.id: (r.out, r.out_status, r.out_source, r.out_model) for r in out.collect()}
        assert [got[i] for i in (0, 1, 2)] == [("A(one)", "translated", "en", "A"), ("B(zwei)", "translated", "de", "B"), ("A(trois)", "translated", "fr", "A")]
        assert got[3] == (("hm hm", "unknown_source", None, None) if unknown == "keep" else ("C(hm hm)", "translated", None, "C"))
        assert [got[i][1] for i in (4, 5, 6, 7, 8)] == ["unchanged", "unchanged", "unsupported_source", "unchanged", None]
    detailed = Translation(routed, "es", preserve=False).translate(df, "text", "out", detection=F.col("d"), codes=part3, detailed=True)
    r = {x.id: x.out for x in detailed.collect()}
    assert (r[1].text, r[1].model, r[1].detected_language, r[1].detection_score, r[1].input_split) == ("B(zwei)", "B", "deu", 0.8, False) and r[8] is None
    assert detailed.columns == [*df.columns, "out"]
    with pytest.raises(ValueError):
        RoutedTranslator({"en": "A"}, {})
    with pytest.raises(ValueError):
        routed.validate("en", "fr")


def test_code_blocks_stand_apart(spark):
    fence = "`" * 3
    text = f"first words\n{fence}\ncode here\n{fence}\nlast words"
    out = Translation(LetterSwap(), "es").translate(spark.createDataFrame([(text,), (f"{fence}\nonly\n{fence}",)], "text string"), "text", "out", source="en").collect()
    assert out[0].out == f"FIRST WORDS\n:es{fence}\ncode here\n{fence}\nLAST WORDS:es"
    assert out[1].out == f"{fence}\nonly\n{fence}" and out[0].out_preservation == "segments"


def test_sql_functions(spark):
    names = register.register(spark)
    row = spark.sql("SELECT vl_rule_label(' ') a, vl_rule_label('12 https://x.org') b, vl_rule_label('it\\'s') c, vl_letter_count('ab. x.org/y cd') d, vl_is_blank(NULL) e, vl_has_linguistic_content('a') f, vl_literals('see x@y.org')[0].kind g, vl_sentences('One. Two words.') h").first()
    assert tuple(row) == ("und", "zxx", None, 4, True, True, "email", ["One.", "Two words."]) and len(names) == 6
    register.register(spark)


def test_stream_stops_early(spark, tmp_path):
    for i in range(6):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_rows(spark, str(tmp_path / "in"), "id long")
    assert len(streams.first_rows(stream, 7, str(tmp_path / "ck"))) == 7
    assert len(streams.first_rows(stream, 500, str(tmp_path / "ck2"))) == 60
    with pytest.raises(ValueError):
        streams.first_rows(stream, 0, "x")


def test_axes_policies_and_retention(spark):
    assert detect.label_axis(["b", "a"], str.upper) == ("B", "A") and detect.label_axis(["b", "a", "B"], str.upper) == ("A", "B")
    assert detect.default_policy() == detect.Policy(min_letters=4, min_score=0.5)
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            detect.BatchDetector(lambda: None, batch_size=bad)
    tied = detect.BatchDetector(lambda: lambda ts: [[("a", 0.5), ("b", 0.5)] for _ in ts], ("b", "a"))
    df = spark.createDataFrame([(1, "some words")], "id long, text string")
    assert detect.LanguageDetection(tied).with_language(df, "id", "text", "l").first().l == "b"
    with pytest.raises(ValueError):
        detect.LanguageDetection(tied).with_language(df, "id", "text", "l", with_score=True, detailed=True)
    rows = spark.createDataFrame([("a x@y.org", "a x@y.org", "placeholders"), ("b x@y.org", "b", "placeholders"), ("c", "c", None)], "t string, o string, p string")
    from verbaloom.functions import literals

    got = evaluate.retention(rows.withColumn("s", literals.find_literals(F.col("t"))), "s", "o", "p").collect()
    assert [tuple(r) for r in got] == [("placeholders", 2, 1, 0.5)]


def test_third_party_openers_need_their_package():
    for opener in (backends.lingua(["eng"]), backends.cld3(), backends.heliport()):
        with pytest.raises(ImportError):
            opener()


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "w.onnx").write_bytes(b"12345")
    files = [{"family": "pair", "precision": "q4", "license": "MIT", "file": "w.onnx", "bytes": 5, "url": (tmp_path / "w.onnx").as_uri()}]
    (tmp_path / "files.json").write_text("\n".join(map(json.dumps, files)))
    base = ["download", "--pair", "en:de", "--files", str(tmp_path / "files.json"), "--cache-dir", str(tmp_path / "c"), "--detector", (tmp_path / "w.onnx").as_uri()]
    assert cli.run(spark, [*base, "--dry-run"]) == 0 and capsys.readouterr().out == "missing\tpair-q4/w.onnx\nmissing\tdetector/w.onnx\n"
    assert cli.run(spark, [*base, "--no-detection"]) == 0 and capsys.readouterr().out == "fetched\tpair-q4/w.onnx\n"
    assert (tmp_path / "c/pair-q4/w.onnx").read_bytes() == b"12345" and cli.run(spark, base) == 0 and capsys.readouterr().out.startswith("there\tpair-q4")
    assert cli.run(spark, ["list", "--files", str(tmp_path / "files.json")]) == 0 and "MIT" in capsys.readouterr().out
    folder = write_folder(tmp_path / "m", "small")
    (tmp_path / "in.txt").write_text("one two\n")
    args = ["translate", str(tmp_path / "in.txt"), "--to", "es", "--from", "en", "--json", "--translator", f"*:small:fp32:{folder}", "--truncate", "--no-preserve-kind", "number"]
    assert cli.run(spark, args) == 0 and f'"model":"small-fp32-m"' in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        cli.run(spark, ["detect", str(tmp_path / "in.txt"), "--model", "nowhere.bin", "--offline", "--cache-dir", str(tmp_path)])

