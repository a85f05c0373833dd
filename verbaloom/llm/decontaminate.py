"""Benchmark decontamination by suffix arrays over training shards.

Every slab of documents is a shard with a suffix array of its words, ordered to the depth of a test window. All test
suffixes are binary-searched in it; hits that follow one another on a diagonal join to the longest verbatim matches.
The array holds only suffixes whose words all occur in the test set: no other suffix can equal a test window.

The corpus is read once, whatever the size of the test set. The test set comes to the driver a partition at a time and
leaves it as blocks of bounded size, each a broadcast of its own; a worker opens one block at a time and searches it in
the slabs of an Arrow batch. What the blocks find in a row meets in the task that read the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import need

#: Test words in a block; at 4 bytes a word, a window's key has 32 bytes, so a block's broadcast has some 20 MB at most.
BLOCK_WORDS = 1 << 19

FOUND = "n_words long, ranges array<long>, items array<string>, best struct<item:string,start:long,length:long>"
SCHEMA = "doc_id long, " + FOUND

#: A block: names by item number, the sorted hashes of its words, the type of word ids, and for each window length the
#: sorted keys with their items and places. Plain values only, so a worker needs no class of this module to read it.
Block = dict


def make_block(pieces: list[tuple[int, str, int, np.ndarray]], window: int) -> Block:
    """The windows of pieces (item number, name, first word, word hashes) as sorted keys for each window length."""
    counts = np.array([len(h) for _, _, _, h in pieces], dtype=np.int64)
    numbers = np.array([k for k, _, _, _ in pieces], dtype=np.int64)
    begins = np.array([b for _, _, b, _ in pieces], dtype=np.int64)
    h = np.concatenate([np.empty(0, np.uint64), *[x for _, _, _, x in pieces]])
    vocabulary = np.unique(h)
    id_type = ">u2" if len(vocabulary) <= 65_535 else ">u4"
    ids = np.searchsorted(vocabulary, h) + 1
    first = np.cumsum(counts) - counts
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for m in sorted({min(int(c), window) for c in counts if c}):
        takes = np.flatnonzero((counts >= window) if m == window else (counts == m))
        n = counts[takes] - m + 1
        at = B.ranges(first[takes], n)
        piece = np.repeat(takes, n)
        keys = keys_of(ids, at, m, id_type)
        order = np.argsort(keys, kind="stable")
        by_length[m] = keys[order], numbers[piece][order], (at - first[piece] + begins[piece])[order]
    return {"names": {k: n for k, n, _, _ in pieces}, "vocabulary": vocabulary, "id_type": id_type, "by_length": by_length}


def keys_of(ids: np.ndarray, at: np.ndarray, m: int, id_type: str) -> np.ndarray:
    """Big-endian keys whose byte order is the order of the word sequences."""
    out = np.empty((len(at), m), dtype=id_type)
    for j in range(m):
        out[:, j] = ids[at + j]
    return out.view(f"S{out.itemsize * m}").ravel()


def search(block: Block, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hits in a shard of words (hashes and rows): place, length, item, place in the item."""
    found: list[tuple[np.ndarray, ...]] = []
    vocabulary = block["vocabulary"]
    if len(vocabulary) and len(h):
        near = np.searchsorted(vocabulary, h)
        near[near == len(vocabulary)] = 0
        ids = np.where(vocabulary[near] == h, near + 1, 0)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for m, (keys, item, at) in block["by_length"].items():
            if len(ids) < m:
                continue
            suffixes = np.flatnonzero((known[m:] - known[:-m] == m) & (rows[m - 1 :] == rows[: len(rows) - m + 1]))
            if not len(suffixes):
                continue
            own = keys_of(ids, suffixes, m, block["id_type"])
            order = np.argsort(own, kind="stable")  # the shard's suffix array
            own, suffixes = own[order], suffixes[order]
            low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            n = high - low
            where = suffixes[B.ranges(low, n)]
            found.append((where, np.full(len(where), m), np.repeat(item, n), np.repeat(at, n)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4


def longest(place: np.ndarray, length: np.ndarray, item: np.ndarray, at: np.ndarray, row: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """By row: item, place and words of its longest match; the first of equals."""
    if not len(place):
        return {}
    order = np.lexsort((place, place - at, item, row))
    place, length, item, at, row = (x[order] for x in (place, length, item, at, row))
    head = np.ones(len(place), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(head)
    sizes = np.diff(np.append(heads, len(place))) - 1 + length[heads]
    best: dict[int, tuple[int, int, int]] = {}
    for r, i, p, n in zip(row[heads].tolist(), item[heads].tolist(), place[heads].tolist(), sizes.tolist(), strict=True):
        if r not in best or n > best[r][2] or n == best[r][2] and p < best[r][1]:
            best[r] = (i, p, n)
    return best


Opener = Callable[[], Iterator[Block]]


def matches_of(texts: pa.Array, blocks: Opener) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """For each slab of an Arrow column: first row, row after the last, and the columns of FOUND."""
    shards = []
    for low, high, data, offsets in B.slabs(texts):
        h, rows, _, _ = B.word_hashes(B.LOWER[data], offsets, B.ALNUM)
        shards.append((low, high, h, rows, []))
    names: dict[int, str] = {}
    for block in blocks():
        for _, _, h, rows, hits in shards:
            found = search(block, h, rows)
            if len(found[0]):
                hits.append(found)
                names |= block["names"]
    for low, high, _, rows, hits in shards:
        counts = np.bincount(rows, minlength=high - low).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        place, length, item, at = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, np.int64),) * 4
        row = rows[place]
        hit = B.covered(place, place + length, int(counts.sum()))
        starts, ends, owner = B.runs(hit, np.append(firsts, len(hit)))
        best = longest(place, length, item, at, row)
        spans: list[list[int]] = [[] for _ in range(high - low)]
        for r, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
            spans[r] += [s - int(firsts[r]), e - int(firsts[r])]
        items: list[list[str]] = [[] for _ in range(high - low)]
        pairs = np.unique(np.stack([row, item], axis=1), axis=0) if len(row) else np.empty((0, 2), int)
        for r, i in pairs.tolist():
            items[r].append(names[i])
        items = [list(dict.fromkeys(x)) for x in items]
        tops = [None if (b := best.get(r)) is None else {"item": names[b[0]], "start": b[1] - int(firsts[r]), "length": b[2]} for r in range(high - low)]
        yield low, high, [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(tops, pa.struct([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    """The test set in blocks of at most block_words words; a longer item is cut into pieces that share window - 1 words."""
    size, held = 0, []
    step = max(block_words, 2 * window)
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), text_col).toLocalIterator()
    for number, (name, text) in enumerate(rows):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        h, _, _, _ = B.word_hashes(B.LOWER[data], np.array([0, len(data)]), B.ALNUM)
        for begin in range(0, max(len(h) - window + 1, 1 if len(h) else 0), step - window + 1):
            piece = h[begin : begin + step]
            if held and size + len(piece) > block_words:
                yield make_block(held, window)
                size, held = 0, []
            held.append((number, "" if name is None else name, begin, piece))
            size += len(piece)
    if held:
        yield make_block(held, window)


def broadcast_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Opener:
    """Sends each block as it is made; what comes back opens them one after another on a worker."""
    context = benchmark.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in blocks_of(benchmark, item_col, text_col, window, block_words)]

    def opened() -> Iterator[Block]:
        for b in sent:
            yield b.value
            if len(sent) > 1:  # the next takes its place; the file of the broadcast stays
                b.__dict__.pop("_value", None)

    return opened


def scan_fn(blocks: Opener):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for low, high, columns in matches_of(batch.column(1), blocks):
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *columns], names=["doc_id", "n_words", "ranges", "items", "best"])

    return scan


def keep_fn(text_at: int, blocks: Opener, min_items: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [np.diff(columns[2].offsets.to_numpy()) < min_items for _, _, columns in matches_of(batch.column(text_at), blocks)]
            yield batch.filter(pa.array(np.concatenate([np.empty(0, bool), *few])))

    return keep


def find_matches(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: n_words, the hit word ranges [start, end, start, end, ...], the items met, the longest match.

    Null and empty texts have no words and no hits. An item with fewer words than the window is one window; one without
    words (or a null text) is met by nothing. Repeated document rows are judged row by row; repeated items count once
    for each different id. Other columns are ignored. A null doc_id gives a row with a null id. An empty table gives an
    empty result, an empty test set meets nothing.
    """
    need(documents, id_col, text_col)
    need(benchmark, item_col, item_text_col)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(scan_fn(broadcast_blocks(benchmark, item_col, item_text_col, window, block_words)), SCHEMA)


def digest(matches: DataFrame, min_items: int = 2) -> DataFrame:
    hit = F.expr("aggregate(IF(size(ranges) = 0, array(), sequence(0, size(ranges) - 2, 2)), 0L, (a, i) -> a + ranges[i + 1] - ranges[i])")
    return matches.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
        F.col("best.item").alias("longest_item"),
        F.col("best.start").alias("longest_start"),
        F.col("best.length").alias("longest_words"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, *, min_items: int = 1, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that meet fewer than min_items items, each row judged by its own text; all columns as they came."""
    need(documents, text_col)
    need(benchmark, item_col, item_text_col)
    inner = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    left = inner.mapInArrow(keep_fn(documents.columns.index(text_col), broadcast_blocks(benchmark, item_col, item_text_col, window, block_words), min_items), inner.schema)
    return left.toDF(*documents.columns)
