"""Best-fit packing of token sequences by a configuration linear program.

Texts become token ids in one pass; where a tokenizer's own settings say that words encode alone, each distinct one is
encoded once per worker and looked up after that; other tokenizers encode texts whole. Only a histogram of piece lengths,
at most one row per possible length, reaches the driver. There
the configuration LP over the histogram is solved by multiplicative weights: each round prices lengths by how little they
are covered yet, a knapsack dynamic program finds the most valuable sequence, and that sequence gets a step of the solution.
Whole multiples of the sequences are kept, and best fit places what rounding leaves. The plan's size depends on the
histogram alone. Pieces find their places by rank among pieces of their length, counted in salted groups.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, need

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Distinct units a worker remembers (some 40 bytes each), and pieces in a salted group.
CACHE_WORDS = 2_500_000
GROUP_PIECES = 50_000
ROUNDS = 120

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# Fixed value: how the tokenizer of word units splits a text.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes that may end a word as a token of their own; none of them begins a contraction or a special token.
ENDING = np.zeros(256, dtype=bool)
ENDING[list(b"!#$%&*,.:;?")] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of what encodes on its own: words, and the punctuation that ends one after a letter.

    Tokens never cross white space, and a run of letters ends where such punctuation begins.
    """
    starts, ends, rows = B.runs(B.NOT_SPACE[data], offsets)
    if not len(starts):
        return starts, ends, rows
    place = np.arange(len(data))
    split = np.maximum.accumulate(np.where(ENDING[data], -1, place))[ends - 1] + 1
    last = data[np.maximum(split - 1, 0)]
    latin = (data[np.maximum(split - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (split - 2 >= starts)
    cuts = np.flatnonzero((split > starts) & (split < ends) & (LETTER[last] | latin))
    twice = np.ones(len(starts), dtype=np.int64)
    twice[cuts] = 2
    starts, ends, rows, split = (np.repeat(x, twice) for x in (starts, ends, rows, split))
    tails = np.cumsum(twice)[cuts] - 1
    starts[tails] = split[tails]
    ends[tails - 1] = split[tails]
    return starts, ends, rows


def words_encode_alone(settings: dict) -> bool:
    """Whether a tokenizer encodes units() one by one as it does whole texts: it lower-cases, takes runs of letters, single
    digits or other marks between white space, forgets the white space, and its special tokens begin with <|."""
    flat = lambda x, inner: [] if not x else x[inner] if x.get("type") == "Sequence" else [x]
    normal = [n["type"] for n in flat(settings.get("normalizer"), "normalizers")]
    cuts = flat(settings.get("pre_tokenizer"), "pretokenizers")
    split = cuts and cuts[0].get("type") == "Split" and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed" and cuts[0]["pattern"].get("Regex") == WORD_SPLIT
    rest = all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex") for c in cuts[1:])
    special = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in settings.get("added_tokens") or [])
    return bool(split and rest and special and "Lowercase" in normal and set(normal) <= {"NFC", "Replace", "Lowercase"} and not settings["model"].get("dropout"))


class WordEncoder:
    """Token ids of units, remembered by their hash in sorted arrays; of whole texts for tokenizers that need them."""

    def __init__(self, path: str, limit: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = words_encode_alone(json.loads(self.tokenizer.to_str()))
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)
        self.starts = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int32)
        self.ids = np.empty(1 << 16, dtype=np.uint16)
        self.used = 0

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes ascend and are not known yet."""
        encoded = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), dtype=np.int32, count=len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), dtype=np.uint32, count=int(sizes.sum()))
        if len(flat) and self.ids.dtype == np.uint16 and flat.max() > 65_535:
            self.ids = self.ids.astype(np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += len(flat)
        at = np.searchsorted(self.known, hashes)
        self.known, self.starts, self.sizes = np.insert(self.known, at, hashes), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slab, and how many each row has."""
        raw = data.tobytes()
        if not self.by_words:
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(counts.sum())), counts
        if b"<|" not in raw:  # special tokens are told by their case; all else is lower-cased before it is encoded
            data = B.LOWER[data]
            raw = data.tobytes()
        starts, ends, rows = units(data, offsets)
        distinct, first, inverse = np.unique(B.span_hashes(B.prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            where = first[new]
            self.learn(distinct[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        entry = np.searchsorted(self.known, distinct)[inverse]
        sizes = self.sizes[entry].astype(np.int64)
        ids = self.ids[B.ranges(self.starts[entry], sizes)]
        return ids, np.bincount(rows, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)


def worker_encoder(path: str, limit: int) -> WordEncoder:
    """One encoder for each Python worker, so that tasks that follow one another share what it has learnt."""
    import builtins

    held = builtins.__dict__.setdefault("_verbaloom_encoders", {})
    if path not in held:
        held[path] = WordEncoder(path, limit)
    return held[path]


def tokenize_fn(tokenizer: str, capacity: int, end_id: int, cache_words: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        encoder = worker_encoder(path, cache_words)
        for batch in batches:
            for low, high, data, offsets in B.slabs(batch.column(1)):
                ids, counts = encoder.encode(data, offsets)
                firsts = np.cumsum(counts) - counts
                lengths = counts + 1
                n = -(-lengths // capacity)
                row = np.repeat(np.arange(high - low), n)
                piece = B.ranges(np.zeros(len(n), dtype=np.int64), n)
                start = piece * capacity
                length = np.minimum(lengths[row] - start, capacity)
                ids = ids.astype("<u4")
                end = np.array([end_id], dtype="<u4").tobytes()
                crc = []
                for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                    f, c = int(firsts[r]), int(counts[r])
                    part = ids[f + s : f + min(s + k, c)].tobytes()
                    crc.append(zlib.crc32(part + end if s + k > c else part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return tokenize


def pieces_of(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. Null text counts as empty: the end id alone."""
    need(documents, id_col, text_col)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tokenize_fn(tokenizer, capacity, end_id, cache_words), PIECES)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The unbounded knapsack: how many of each length the most valuable sequence holds. lengths ascend."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            got = best[c - lengths[:k]] + values[:k]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], take[c] = got[i], i
    out = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= int(lengths[take[c]])
    return out


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Sequences and fractional multiplicities that cover the histogram: multiplicative weights, a priced sequence a round."""
    total = float(np.dot(lengths, counts))
    weights = lengths / total  # duals, as if all sequences were full
    covered = np.zeros(len(lengths))
    found: dict[bytes, list] = {}
    step = max(1.0, total / capacity / rounds)
    for _ in range(rounds * 2):
        left = np.maximum(counts - covered, 0)
        if not left.any():
            break
        a = price(np.where(left > 0, weights, 0), lengths, capacity)
        used = a > 0
        if not used.any():
            break
        size = min(step, float((np.maximum(left[used], 1) / a[used]).min()) + step * 0.1)
        found.setdefault(a.tobytes(), [a, 0.0])[1] += size
        covered += a * size
        weights = weights * np.exp(-0.5 * a * size / counts)
    return [(a, x) for a, x in found.values()]


class Plan:
    """Places by length and rank: rank r in [first, first + n) goes to sequence base + (r - first) // each, at offset + ((r - first) % each) * length."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.entries: list[tuple[int, int, int, int, int, int]] = []
        self.taken: dict[int, int] = {}
        self.caps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, n: int, base: int, offset: int, each: int) -> None:
        first = self.taken.get(length, 0)
        self.entries.append((length, first, n, base, offset, each))
        self.taken[length] = first + n

    def leave(self, free: int, base: int, n: int) -> None:
        """n sequences from base on have this much room left."""
        if n and free:
            if free not in self.open:
                bisect.insort(self.caps, free)
                self.open[free] = []
            self.open[free].append((base, n))

    def configuration(self, lengths: list[int], a: list[int], n: int) -> None:
        offset = 0
        for length, k in zip(lengths, a, strict=True):
            self.put(length, n * k, self.sequences, offset, k)
            offset += length * k
        self.leave(self.capacity - offset, self.sequences, n)
        self.sequences += n

    def best_fit(self, length: int, count: int) -> None:
        """Places count pieces of a length, each into the fullest sequence that has room; runs of equal sequences at once."""
        while count:
            i = bisect.bisect_left(self.caps, length)
            if i == len(self.caps):
                free, base, n = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += n
            else:
                free = self.caps[i]
                base, n = self.open[free].pop()
                if not self.open[free]:
                    del self.open[free]
                    self.caps.pop(i)
            each = free // length
            full = min(n, count // each)
            if full:
                self.put(length, full * each, base, self.capacity - free, each)
                self.leave(free - each * length, base, full)
                count -= full * each
            if full < n and count and count < each:
                self.put(length, count, base + full, self.capacity - free, count)
                self.leave(free - count * length, base + full, 1)
                count, full = 0, full + 1
            if full < n:
                self.leave(free, base + full, n - full)


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The plan with fewer sequences: the rounded LP with best fit for the rest, or best fit, longest first, alone."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    plain = Plan(capacity)
    for x, n in zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True):
        plain.best_fit(x, n)
    if not len(lengths):
        return plain
    rounded, left = Plan(capacity), counts.copy()
    for a, x in sorted(solve_configurations(lengths, counts, capacity, rounds), key=lambda p: -p[1]):
        used = a > 0
        n = min(int(x), int((left[used] // a[used]).min()))
        if n > 0:
            rounded.configuration(lengths[used][::-1].tolist(), a[used][::-1].tolist(), n)
            left -= a * n
    for x, n in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        rounded.best_fit(x, n)
    return rounded if rounded.sequences <= plain.sequences else plain


def place_fn(entries: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            e = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            at = rank - e[:, 1]
            out = batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(e[:, 3] + at // e[:, 5])).append_column("offset", pa.array(e[:, 4] + at % e[:, 5] * length))
            yield out

    return place


def pack(documents: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS, **options) -> DataFrame:
    """A row per piece of every document row: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is its tokens and the end id; only longer ones than the capacity are cut, at its multiples. Sequences
    are filled without gaps from 0. Null and empty texts are the end id alone. Repeated rows are packed each; which of
    two equal pieces goes where is fixed by the written table. A null id is kept. Empty tables give an empty result.
    """
    pieces = cut(pieces_of(documents, capacity=capacity, **options).withColumn("__key", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    histogram = {int(r.length): r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = make_plan(histogram, capacity, rounds)
    total = sum(histogram.values())
    # At least as many groups as tasks, so a frequent length is ranked by all of them.
    salts = max(1, -(-total // group_pieces), min(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 500))
    salted = pieces.withColumn("__salt", F.pmod("__key", F.lit(salts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "__key")
    ranked = salted.withColumn("__i", F.row_number().over(within) - 1).join(bases, ["length", "__salt"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__i") + F.col("__base")).cast("long").alias("rank"))
    return rows.mapInArrow(place_fn(plan.entries), PIECES + ", sequence_id long, offset long")
