import hashlib
import random
import re

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from verbaloom.llm import decontaminate, jaccard_join, licenses, line_dedup, packing, pii, quality, queries, sharding, substring_dedup, suffix_order, url_rules
from verbaloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, part int, n int, kind int"


def table(spark, texts, lang="en"):
    """A documents table whose further columns clash with names inside the operators."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "r", 1, 2, 3) for i, t in texts], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=7):
    """Nulls, blanks, short and very long texts, exact and near copies in groups, shared passages and lines."""
    rng = random.Random(seed)
    base, passage = [words(rng, 60) for _ in range(6)], words(rng, 70)
    texts = [None, "", " \n\t ", "one", "one two three", "one two three", "a\nb\na\nb", "x" * 5000, "ab" * 300, "é" * 220]
    for b in base:
        texts += [b, b, b + " extra", b.replace("w1", "W1")]
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [f"{words(rng, 30)}\n{passage}\nshared line\n{words(rng, 20)}" for _ in range(20)]
    texts += [words(rng, 9000, 3000), "\n".join(words(rng, 3, 5) for _ in range(400))]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3)


def test_line_dedup(spark, docs, rows):
    clash = docs.withColumnsRenamed({"part": "n_removed", "n": "n_runs", "kind": "row", "rep": "text_"})
    found = line_dedup.dedup_lines(clash)
    assert found.columns == [*clash.columns, "n_lines", "n_removed_", "n_runs_"]
    out = {r.doc_id: r for r in found.collect()}
    for i, (n, removed, runs, kept) in plain.lines(rows).items():
        r = out[i]
        assert (r.n_lines, r.n_removed_, r.n_runs_, r.text or "") == (n, removed, runs, kept), i
        assert (r.n_removed, r.n_runs, r.row, r.text_) == (1, 2, 3, "r")
    got = {r.doc_id: (r.n_removed, r.text or "") for r in line_dedup.dedup_lines(docs, min_lines=3, long_words=30).collect()}
    assert got == {i: (x[1], x[3]) for i, x in plain.lines(rows, 3, 30).items()}
    for bad in ({"min_lines": 0}, {"long_words": 0}):
        with pytest.raises(ValueError):
            line_dedup.dedup_lines(docs, **bad)


def test_suffix_array(spark):
    rng = random.Random(4)
    run = [rng.randrange(4) for _ in range(9)]
    rows = [(i, [*[rng.randrange(5) for _ in range(rng.randrange(0, 6))], *run[: rng.randrange(4, 10)], 100 + i, *[rng.randrange(3)] * rng.randrange(0, 5)]) for i in range(12)]
    df = spark.createDataFrame([(i, i, p, 7, x, 0, 0) for i, ls in rows for p, x in enumerate(ls)], "id long, row long, at int, tag int, a long, b int, c int")
    want, shared = plain.suffixes(rows)
    for depth in (1, 3):
        got = suffix_order.suffix_array(df.repartition(3), depth).orderBy("rank").collect()
        assert [(r.id, r.at) for r in got] == want and [r.rank for r in got] == list(range(len(want))) and {r.tag for r in got} == {7}
        for r, n in zip(got, shared, strict=True):
            assert r.shared == n if n < depth else depth <= r.shared <= n
        # Intervals of the array: neighbours that share so many symbols.
        for name, least in (("first_1", 1), ("first_d", depth)):
            k = 0
            while k < len(got):
                end = k + 1
                while end < len(got) and shared[end] >= least:
                    end += 1
                first = min((got[j].id, got[j].at) for j in range(k, end))
                for j in range(k, end):
                    f = got[j][name]
                    assert (f.id, f.at) == first if end - k > 1 else f is None or (f.id, f.at) == first
                k = end


def test_pii_base_is_exact():
    rng = random.Random(3)
    parts = ["1", "23", ".", " ", "-", "@", "a", "b.c", "+", "(", ")", "255", "256", "4111111111111111", "é", "_", "%", "🙂"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert plain.pii(text) == pii.base_spans(text), text


def test_pii(spark, docs):
    card = "4111111111111111"
    texts = ["mail a.b@c.de and 10.0.0.1", f"card {card} then {card} {card} end", "call +1 (555) 555-0100 now", "a@b 1.2.3.999", None, "", "🙂 x@y.zz"] * 30
    found = {r.doc_id: r for r in pii.digest(pii.find_pii(table(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        spans = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain.pii(t)]
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(found[i].spans.split(",")) | {""}
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
    # Two cards in a row are one run of 32 digits to the pattern; repeats elsewhere carry the label to both.
    assert found[1].n_card == 1 and found[1].spans.count("card:") == 3
    odd = [(1, texts[0]), (1, texts[2]), (None, "from 10.0.0.1"), (2, None), (2, "")]
    masked = pii.mask(spark.createDataFrame(odd, "doc_id long, text string").withColumns({"base": F.lit(1), "spans": F.lit("x")})).collect()
    assert sorted((r.doc_id or 0, r.text or "-") for r in masked) == [(0, "from <ip>"), (1, "call <phone> now"), (1, "mail <email> and <ip>"), (2, "-"), (2, "-")]


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(1)
    nodes = pii.Nodes()
    nodes.features = [("f",) * 7] * 4
    nodes.chain, nodes.skip = [(0, 1), (1, 2)], [(1, 3)]
    field = pii.Field({}, rng.normal(size=(2, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    local = field.node(nodes.features)
    joint = sum(x.reshape([5 if k == i else 1 for k in range(4)]) for i, x in enumerate(local))
    joint = joint + field.chain[:, :, None, None] + field.chain[None, :, :, None] + field.skip[None, :, None, :]
    p = np.exp(joint - joint.max())
    got = field.beliefs(nodes, np.zeros(4, int))
    for i in range(4):
        want = p.sum(axis=tuple(k for k in range(4) if k != i))
        assert np.allclose(got[i], want / want.sum(), atol=1e-3)


def mentions(rng, n):
    """Texts, and the spans that no base pattern finds: values that a pattern finds once and that come again, written otherwise."""
    texts, wanted = [], []
    for _ in range(n):
        d = [f"{rng.randrange(10**k):0{k}d}" for k in (3, 3, 4)]
        ip = [str(rng.randrange(1, 255)) for _ in range(4)]
        name = f"u{rng.randrange(10**4)}x"
        kinds = {
            "phone": (f"+1 {d[0]} {d[1]} {d[2]}", f"1{d[0]}{d[1]}{d[2]}"),
            "ip": (".".join(ip), "-".join(ip)),
            "email": (f"{name}@mail.example.com", f"{name}(at)mail.example[dot]com"),
        }
        kind = rng.choice(sorted(kinds))
        sure, other = kinds[kind]
        filler = lambda: "so " + " ".join(rng.choice(["ask", "for", "it", "at", "the", "desk", f"{rng.randrange(99)}", f"no{rng.randrange(9)}", "in", "20" + str(rng.randrange(10, 30))]) for _ in range(rng.randrange(3, 25))) + " by"
        parts = [filler(), sure, filler(), other, filler(), other, filler()]
        if rng.random() < 0.5:
            parts[1], parts[3] = parts[3], parts[1]
        if rng.random() < 0.2:  # values that no pattern finds anywhere stay plain
            parts = [x for x in parts if x != sure]
        text = " ".join(parts)
        texts.append(text)
        found = {x[0] for x in pii.base_spans(text)}
        wanted.append({(m.start(), m.end()) for m in re.finditer(re.escape(other), text)} if sure in parts and found else set())
    return texts, wanted


def test_skip_edges_find_what_patterns_cannot():
    rng = random.Random(12)
    field = pii.train(mentions(rng, 600)[0])
    texts, wanted = mentions(rng, 300)
    spans = [pii.base_spans(t) for t in texts]

    def score(field):
        added = pii.added_spans(field, texts, spans, pii.MIN_BELIEF)
        right = sum((s, e) in w for a, w in zip(added, wanted, strict=True) for s, _, e in a)
        return right, sum(map(len, added)) - right

    right, wrong = score(field)
    assert right >= 0.95 * sum(map(len, wanted)) > 400 and wrong <= 0.02 * right
    plainer = pii.Field(field.index, field.weights, field.chain, 0 * field.skip)
    assert score(plainer)[0] < 0.2 * right


def test_far_repeats_carry_labels():
    field = pii.Field({}, np.zeros((2, 5)), np.zeros((5, 5)), 4.0 * np.eye(5))
    field.weights[1, 0] = 1.0  # without an edge a token is nothing
    text = "call +15555550100 now, or ask at the desk for 15555550100 again"
    at = text.rindex("15555550100")
    assert pii.added_spans(field, [text], [pii.base_spans(text)], 0.5) == [[(at, 3, at + 11)]]
    many = "+1 555 010 0199" + " or at the desk 15550100199" * 40
    assert [len(x) for x in pii.added_spans(field, [many], [pii.base_spans(many)], 0.5)] == [40]

    def edges(text):
        nodes = pii.Nodes()
        nodes.add(0, text, pii.base_spans(text), pii.tokens_near(text))
        return nodes.chain, sorted(set(nodes.skip))

    assert edges("x1234567 x1234567 and then x1234567") == ([(0, 1)], [(1, 2)])
    assert edges("x1234567 a b c x1234567 y2 x1234567") == ([(1, 2), (2, 3)], [(0, 1), (1, 3)])
    assert edges("+1 555 010 0199 a b c 15550100199") == ([(0, 1), (1, 2), (2, 3)], [(0, 4), (3, 4)])


def test_jaccard(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()}
    assert got == plain.components(rows)
    small = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs, slab=4000).collect()}
    assert small == got
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_jaccard_near_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for n in (8, 9, 13, 14, 24, 49):
        base = [f"b{n}x{i}" for i in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.choice([0, -1])] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(table(spark, rows)).collect()}
    assert got == plain.components(rows)


def test_quality(spark, docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in rows:
        r = got[i]
        want = plain.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    english = [" ".join(random.Random(i).choice(("the", "of", "and", "house", "walks", "river", "in", "to", "quiet", "morning")) + str(i % 7) * (k % 5 == 0) for k in range(120)) for i in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in english[0].split()), " ".join(w + "###" for w in english[1].split())]
    judged = {r.doc_id: r.kept for r in quality.judge(table(spark, list(enumerate(english + junk)))).where("not base_failed").collect()}
    assert all(judged[i] for i in range(60) if i in judged)
    assert not any(judged.get(i, False) for i in (60, 61))
    assert quality.keep_good(docs).columns == docs.columns


def test_substrings(docs, rows):
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    for i, (n, removed, spans, kept) in plain.substrings(rows).items():
        r = out[i]
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, bytes(r.kept)) == (n, removed, spans, kept), i
    small = substring_dedup.dedup_substrings(docs, window=20, gram=6, slab=3000)
    assert {r.doc_id: bytes(r.kept) for r in small.collect()} == {i: x[3] for i, x in plain.substrings(rows, 20).items()}
    split = substring_dedup.dedup_substrings(docs, window=20, gram=6, slab=3000, many=3)
    assert {r.doc_id: bytes(r.kept) for r in split.collect()} == {i: x[3] for i, x in plain.substrings(rows, 20).items()}


def test_suffix_ranks_order_bytes():
    rng = np.random.default_rng(3)
    for depth in (1, 5, 8, 20, 100):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        got = substring_dedup.suffix_ranks(data, depth)
        windows = [data[i : i + depth].tobytes() for i in range(len(data) - depth + 1)]
        place = {w: k for k, w in enumerate(sorted(set(windows)))}
        assert got.tolist() == [place[w] for w in windows]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing(docs, rows):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    out = packing.pack(docs, group_pieces=20).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out}
    want = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for p in range(-(-len(ids) // 4096)):
            part = ids[p * 4096 : (p + 1) * 4096]
            want[i, p] = (p * 4096, len(part), zlib.crc32(part.tobytes()))
    assert got == want
    total = sum(x[1] for x in want.values())
    assert check_packing(out, 4096) <= -(-total // 4096) + 1


def test_units_encode_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from verbaloom.llm import bytesops

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path, 50)
    rng = random.Random(11)
    parts = ["a", "Word", "É", "é", "İ", "́", "'s", "'", "’ll", "!", ".", "...", "9", " ", "  ", "\n", " ", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "🙂", "×", "<", "̸", "K", "ß", "Σ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    import pyarrow as pa

    for _, _, data, offsets in bytesops.slabs(pa.array(texts)):
        pass
    got, k = [], 0
    for low, high, data, offsets in bytesops.slabs(pa.array(texts), 2000):
        ids, counts = encoder.encode(data, offsets)
        at = 0
        for n in counts.tolist():
            got.append(ids[at : at + n].tolist())
            at += n
        k += high - low
    for t, g in zip(texts, got, strict=True):
        assert tokenizer.encode(t, add_special_tokens=False).ids == g, repr(t)


def test_plans_of_histograms():
    rng = random.Random(2)
    for trial in range(12):
        capacity = rng.choice([10, 64, 256])
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 200) for _ in range(rng.randrange(0, 30))}
        plan = packing.make_plan(histogram, capacity, 40)
        seen = {}
        used = {}
        for length, first, n, base, offset, each in plan.entries:
            for r in range(n):
                assert (length, first + r) not in seen
                seen[length, first + r] = 1
                used.setdefault(base + r // each, []).append((offset + r % each * length, length))
        assert {x: sum(k[0] == x for k in seen) for x in histogram} == histogram
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity
        assert plan.sequences == len(used)
        half = sum(n for x, n in histogram.items() if 2 * x > capacity)
        assert plan.sequences >= max(half, -(-sum(x * n for x, n in histogram.items()) // capacity))


def test_the_linear_program_beats_best_fit():
    """Histograms on which best fit alone, longest first, needs more sequences than the rounded program."""
    rng = random.Random(1)
    wide = {rng.randrange(800, 2400): rng.randrange(1, 200) for _ in range(60)}
    for histogram, capacity, bound in (({51: 60, 27: 60, 26: 60, 23: 120}, 100, 90), (wide, 4096, -(-sum(x * n for x, n in wide.items()) // 4096))):
        alone = packing.Plan(capacity)
        for x in sorted(histogram, reverse=True):
            alone.best_fit(x, histogram[x])
        plan = packing.make_plan(histogram, capacity)
        assert bound <= plan.sequences < alone.sequences and plan.sequences <= 1.02 * bound


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from verbaloom.llm import bytesops

    texts = ["Hello World, hello  world", "", "naïve Ünïcode 123\n\ttab", "x" * 50]
    for name, by_words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        encoder, tokenizer = packing.WordEncoder(path, 50), Tokenizer.from_file(path)
        assert encoder.by_words == by_words
        (_, _, data, offsets), = bytesops.slabs(pa.array(texts))
        ids, counts = encoder.encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_licenses(docs, spark, rows):
    texts = [*[t for _, t in rows], "Under the GNU general\npublic  LICENSE. mit license cc-by; the MIT License", "Released under the MIT License.", "this work is, licensed under the gnu public license (version 3)", "K mit licenſe", "permit license", "x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met\ny"]
    got = {r.doc_id: r for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain.license_base(t, licenses.PHRASES), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    n = len(rows)
    assert got[n].labels == "cc-by,gpl,mit" and got[n + 2].labels == "gpl" and got[n + 2].n_base == 0 and 0.8 <= got[n + 2].score < 1
    assert got[n + 5].labels == "bsd" and got[n + 5].score == 1
    same = licenses.scan(spark.createDataFrame([(1, "Released under the MIT License."), (1, "no notice"), (None, "Released under the MIT License.")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in same) == [(0, "mit"), (1, ""), (1, "mit")]
    # Every block and template by definition.
    for i, t in enumerate(texts):
        best = {}
        lines = [plain.WORD.findall(plain.lower(x)) for x in (t or "").split("\n")]
        runs = [sum(lines[i : i + n], []) for i in range(len(lines)) for n in range(1, licenses.MAX_LINES + 1) if n == 1 or i + n <= len(lines) and lines[i] and sum(map(len, lines[i : i + n])) <= licenses.MAX_BLOCK_WORDS]
        for b in map(set, runs):
            for label, notice in licenses.TEMPLATES:
                w = set(licenses.words_of(notice))
                if len(b & w) >= 0.8 * len(w) - 1e-9:
                    best[label] = max(best.get(label, 0), len(b & w) / len(w))
        assert set(filter(None, got[i].labels.split(","))) == set(best) | set(filter(None, got[i].base_labels.split(",")))


def test_sharding(spark, docs, rows, tmp_path):
    store = sharding.ingest(docs, f"file://{tmp_path}/store", arrivals=5, target_bytes=1 << 20, smallest_bytes=1 << 10, fan_in=2)
    same = lambda df: sorted((repr(tuple(r)) for r in df.collect()))
    assert same(store.read()) == same(docs)
    assert not store.due()
    placed = sharding.placement(store)
    assert placed.where("shard IS NULL OR shard_bytes <= 0").isEmpty() and placed.select("shard").distinct().count() == len(store.shards())
    before = store.version()
    with pytest.raises(sharding.CommitConflict):
        store.commit(before - 1, docs.schema.json(), [])
    assert store.version() == before
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))
    store.append(docs.limit(0))
    assert same(store.read(before)) == same(docs)
    assert placed.columns == [*docs.columns, "shard", "shard_bytes", "version"]
    assert sharding.ingest(docs.limit(0), f"file://{tmp_path}/empty", arrivals=2).read().isEmpty()
    clash = docs.withColumnsRenamed({"part": "shard", "n": "version", "kind": "arrival"})
    other = sharding.placement(sharding.ingest(clash, f"file://{tmp_path}/clash", arrivals=2))
    assert other.columns == [*clash.columns, "shard_", "shard_bytes", "version_"] and same(other.select(clash.columns)) == same(clash)


def test_which_shards_merge():
    """Tiers by definition: from the smallest up, the first tier with fan_in shards below half of the target."""
    rng = random.Random(8)
    for _ in range(300):
        store = sharding.ShardStore.__new__(sharding.ShardStore)
        store.smallest_bytes, store.fan_in = rng.choice([10, 100]), rng.choice([2, 3, 4])
        store.target_bytes = store.smallest_bytes * rng.choice([5, 50, 500])
        held = [sharding.Shard(f"s{i}", rng.randrange(1, 2 * store.target_bytes)) for i in range(rng.randrange(0, 14))]
        store.shards = lambda held=held: held
        tiers = {}
        for x in held:
            if 2 * x.size < store.target_bytes - store.target_bytes % 2:
                t = 0
                while x.size >= store.smallest_bytes * store.fan_in * store.fan_in**t:
                    t += 1
                tiers.setdefault(t, []).append(x)
        want = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= store.fan_in), [])
        assert store.due() == want


def test_decontamination(spark, docs, rows):
    source = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(f"i{k}", " ".join(t.split()[5:25])) for k, t in enumerate(source[:20])] + [("short", "one two three"), ("none", "!!"), ("null", None), ("dup", " ".join(source[0].split()[5:25]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = plain.contamination(rows, items)
    for block in (1 << 19, 25):
        found = decontaminate.find_matches(docs, bench, block_words=block)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(found).collect()}
        assert got == want
    best = {r.doc_id: r for r in decontaminate.digest(decontaminate.find_matches(docs, bench)).collect()}
    assert max(r.longest_words or 0 for r in best.values()) == 20
    for least in (1, 2):
        kept = decontaminate.remove_contaminated(docs, bench, min_items=least)
        assert kept.schema == docs.schema
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x[2] < least)
    none = decontaminate.find_matches(docs, bench.limit(0))
    assert decontaminate.digest(none).where("n_items > 0").isEmpty() and none.count() == len(rows)


def test_decontamination_by_row_at_any_block_size(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 12, 10**6) for _ in range(3))
    rows = [(1, f"x {a} y"), (1, f"{b} z z"), (1, f"x {a} y"), (2, f"{a} {b}"), (2, "plain words"), (None, f"x {b} {c}"), (None, "nothing here"), (None, None), (3, f"{c} and {a}")]
    items = [("i", a), ("i", a), ("j", b), ("i", c), ("j", "no match of any row at all in this item"), (None, "x y")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    want = sorted([(i, *plain.contamination([(0, t)], items)[0]) for i, t in rows], key=repr)
    for block in (1 << 19, 20, 1):
        found = decontaminate.find_matches(docs, bench, block_words=block)
        got = decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect()), key=repr) == want, block
        whole = sorted(map(repr, map(tuple, found.collect())))
        first = whole if block == 1 << 19 else first
        assert whole == first, block
        left = decontaminate.remove_contaminated(docs, bench, min_items=2, block_words=block)
        assert sorted(map(tuple, left.collect()), key=repr) == sorted([x for x, w in zip(rows, (plain.contamination([(0, t)], items)[0] for _, t in rows), strict=True) if w[2] < 2], key=repr), block


def test_decontamination_by_an_item_of_many_words(spark):
    long = [f"v{i}" for i in range(70_000)]
    rows = [(0, " ".join(long[40_000:40_030])), (1, "a b c d e f g h"), (2, " ".join(["x", *long[-9:], *long[:8], "y"])), (3, " ".join(long[:7]))]
    items = [("long", " ".join(long)), ("short", "a b c"), ("other", " ".join(long[-8:]))]
    for block in (1 << 19, 5000):
        found = decontaminate.find_matches(table(spark, rows), spark.createDataFrame(items, "item_id string, text string"), block_words=block)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(found).collect()}
        assert got == plain.contamination(rows, items) and [got[i][1] for i in range(4)] == [30, 3, 17, 0]


def page(url, *tags):
    return (url, "<html>" + "".join(tags) + "</html>")


def test_url_rules(spark):
    canonical = lambda u: f'<LINK href="{u}" rel="canonical">'
    refresh = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    pages = [
        page("https://a.org/x", canonical("http://B.example.com/en/1")), page("http://b.example.com/en/1#top"), page("https://c.org/y", refresh("/z")), page("https://c.org/z", canonical("https://a.org/x")),
        page("https://d.org/", canonical("https://www.example.com/en/q"), canonical("http://b.example.com/en/1")), page("https://www.example.com/en/q"), page("https://e.org/1"), page(None), page("nothing"), page("HTTP://Sub.NET/fr/p?x#y"), page("http://net/es"), (None, None),
        page("https://f.org/a", canonical("b")), page("https://f.org/b", canonical("https://k.net/fr/1")),
    ]
    df = spark.createDataFrame([(i, u, h, "n", "r") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, node string, rule string")
    got = {r.page_id: r for r in url_rules.judge(df).collect()}
    assert [(r.host, r.path) for r in (got[7], got[8], got[9])] == [("", ""), ("", ""), ("sub.net", "/fr/p")]
    assert got[1].rule == "example.com/en/" and got[1].verdict == "block" and got[5].rule == "www.example.com/en/" and got[9].rule == "net/fr/" and got[10].rule is None
    # One component holds a block and an explicit allow: the allow wins for those without a rule.
    assert [got[i].verdict for i in (0, 2, 3, 4)] == ["allow"] * 4
    assert [got[i].verdict for i in (6, 7, 8, 10, 11)] == ["allow"] * 5
    # A target outside the table carries no rule of its own.
    assert [got[i].verdict for i in (12, 13)] == ["allow", "allow"]
    blocked = [page("https://a.org/x", canonical("http://b.example.com/en/1")), page("http://b.example.com/en/1"), page("https://c.org/z", canonical("https://a.org/x"))]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(blocked)], "page_id long, url string, html string")
    assert {r.verdict for r in url_rules.judge(df).collect()} == {"block"}
    assert url_rules.judge(df.limit(0)).isEmpty()


def test_url_spellings_and_logged_redirects(spark):
    spelled = ["http://www.x.org/a/", "https://x.org/a?utm_source=feed", "https://m.x.org/a.html#top", "https://x.org/a/index.html?ref=q&utm_medium=z", "https://x.org/a?page=2&ref=x", "https://x.org/b", "https://m.org/", "old://z.net/fr/q"]
    df = spark.createDataFrame(list(enumerate(spelled)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    rows = df.select("page_id", url_rules.canonical_node("url").alias("n")).collect()
    assert [r.n for r in sorted(rows)] == ["x.org/a"] * 4 + ["x.org/a?page=2", "x.org/b", "m.org", "z.net/fr/q"]
    log = spark.createDataFrame([("http://x.org/a", "https://z.net/fr/q"), ("https://x.org/b", None), (None, "nothing")], "a string, b string")
    rules = (("block", "net", "/fr/"), ("allow", "none", "/"), *((("block"), f"h{i}.org", "/p/") for i in range(30)))
    for few in (500, 3):  # the rules in the plan, and as a table
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(df, rules, edges=log, listed_rules=few).collect()}
        assert got == {**{i: (None, "block") for i in range(4)}, **{i: (None, "allow") for i in (4, 5, 6)}, 7: ("net/fr/", "block")}
    alone = {r.page_id: r.verdict for r in url_rules.judge(df, rules, edges=log, spellings=False).collect()}
    assert [i for i in alone if alone[i] == "block"] == [7]


def test_many_rules_equal_listed_ones(spark):
    rng = random.Random(6)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", ""], ["/", "/p/", "/p/q", "", "/z"]
    rules = tuple((rng.choice(["allow", "block"]), rng.choice(hosts[:5]), rng.choice(["/", "/p/", "/p/q"])) for _ in range(12))
    rules = tuple({r[1:]: r for r in rules}.values())
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(80)] + [(90, None), (91, "q")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("html", F.lit(""))
    a, b = ({r.page_id: tuple(r) for r in url_rules.judge(df, rules, listed_rules=n).collect()} for n in (500, 0))
    assert a == b


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    loose = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_empty_tables_and_odd_rows(spark):
    empty = table(spark, [])
    odd = spark.createDataFrame([(None, None, None), (None, "some words here", "en"), (5, "same text of a row", "en"), (5, "same text of a row", "en"), (5, "another text of a row", None)], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([("a", "x y z")], "item_id string, text string")
    for run in (line_dedup.dedup_lines, pii.find_pii, jaccard_join.link_documents, quality.judge, substring_dedup.dedup_substrings, packing.pack, licenses.scan, lambda d: decontaminate.find_matches(d, bench), quality.keep_good, jaccard_join.keep_first):
        assert run(empty).count() == 0
        assert run(odd).count() in ((5, 0, 4) if run in (quality.keep_good, jaccard_join.keep_first) else (5,))


def test_queries_against_sql(spark, data):
    import duckdb

    from verbaloom.llm import oracles

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in oracles.ORACLES.items():
        want = c.execute(sql)
        names = [x[0] for x in want.description]
        got = queries.QUERIES[name](spark, data).select(*names)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall())), name
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}


def test_substring_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_substring_dedup(spark, data).collect()}
    assert got == {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in plain.substrings(rows).items()}
