"""Exact substring dedup by prefix-free parsing: every byte that an earlier equal window of 100 bytes covers goes.

A rolling hash over the bytes triggers phrases: a gram whose hash is 0 modulo RESIDUE is a trigger, and the windows from one
trigger to the next belong to the latter; where a window holds no such gram, its gram with the smallest hash stands in. So
equal windows have equal triggers and no window lacks one. A phrase is what the windows of one trigger cover; like the
phrases of prefix-free parsing it overlaps its neighbours, here by a window less a byte, so each window lies whole in one
phrase. The dictionary holds each distinct phrase once, with its first place; the parse is the phrases' places.

Only phrases of one trigger can share a window, so the dictionary is dealt out by trigger. Its suffix array orders the
suffixes of a part's phrases by their bytes to the depth of a window: eight bytes at first, then by prefix doubling. The
parse orders what is equal there by place, and together they are the corpus order of all windows up to that depth: all but
the first of equal neighbours are later copies. A phrase that the parse holds again is a later copy as a whole, so
repetitive text costs what its dictionary costs.

A trigger with very many phrases, as at the edge of a passage that many documents share, is split: its windows are dealt
by their own hash, with no need to bring its phrases together. Texts travel in packed chunks of bounded size; a table of
chunks is written once and both later passes read it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, need
from .jaccard_join import groups, pack64, pack_flat, unpack64, unpack_flat

WINDOW = 100
GRAM = 32
RESIDUE = 64
#: Distinct phrases of a trigger that are compared in one task; above that each window is dealt by its own hash.
MANY_PHRASES = 20_000

#: kind 0: a chunk's ids and texts. 1: phrases of a part. 2: places to remove. 3: places to compare. 4: their bytes.
#: 5: places to compare of a trigger with many phrases. 6: hashes and places of their windows.
ROWS = "kind int, part long, chunk long, n long, a binary, b binary"
_NAMES = ("kind", "part", "chunk", "n", "a", "b")
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
PLACE = np.dtype([("row", "<u4"), ("start", "<u4"), ("n", "<u4")])
PHRASE = np.dtype([("hash", "<u8"), ("id", "<i8"), ("row", "<u4"), ("start", "<u4"), ("n", "<u4")])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=list(_NAMES))


def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 128):
        yield batch_of(rows[i : i + 128])


def pack_rows(x: np.ndarray) -> bytes:
    """A structured array in byte planes."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpack_rows(blob: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=n * dtype.itemsize, codec="zstd"), dtype=np.uint8).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def chunk_fn(slab: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for low, high, data, offsets in B.slabs(batch.column(1), slab):
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(np.diff(offsets))], names=["id", "size"])
                with pa.ipc.new_stream(sink, rows.schema) as w:
                    w.write_batch(rows)
                yield batch_of([(0, 0, chunk, len(data), sink.getvalue().to_pybytes(), pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else b"")])
                chunk += 1

    return chunks


def open_chunk(n: int, a: bytes, b: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ids as numbers with nulls first, bytes and offsets."""
    rows = pa.ipc.open_stream(a).read_all().combine_chunks()
    ids = rows.column("id").combine_chunks()
    data = np.frombuffer(pa.decompress(b, decompressed_size=n, codec="zstd"), dtype=np.uint8) if n else np.empty(0, np.uint8)
    return ids, ids.fill_null(-(2**63)).to_numpy(), data, np.concatenate([[0], np.cumsum(rows.column("size").to_numpy())]).astype(np.int64)


def phrases_of(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hash, phrase hash, row, first window and number of windows of each phrase."""
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < window:
        return none
    sums = B.prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = B.span_hashes(sums, at, at + gram)
    low = np.where(grams % np.uint64(RESIDUE) == 0, np.uint64(0), grams)  # the first such gram of a window is its trigger
    place = at.astype(np.int32)
    reach, width = 1, window - gram + 1
    while reach < width:  # the first smallest gram of `reach` consecutive ones, doubled; the last step overlaps
        step = min(reach, width - reach)
        right = low[step:] < low[:-step]
        place = np.where(right, place[step:], place[:-step])
        low = np.where(right, low[step:], low[:-step])
        reach += step
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= window)
    if not len(rows):
        return none
    windows = sizes[rows] - window + 1
    starts = B.ranges(offsets[rows], windows)
    owner = np.repeat(rows, windows)
    trigger = place[starts]
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(head)
    n = np.diff(np.append(heads, len(starts)))
    first, row = starts[heads], owner[heads]
    # Residues and smallest hashes leave bits that say nothing; mixed once more they deal evenly.
    return B.mix(grams[trigger[heads]]), B.span_hashes(sums, first, first + n + window - 1), row, first - offsets[row], n


def first_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the last is the first to compare) and which of the ordered rows begin a group of the last two."""
    order = np.lexsort(keys)
    head = np.ones(len(order), dtype=bool)
    a, b = keys[-1][order], keys[-2][order]
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, head


def deal_fn(parts: int, window: int, gram: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, a, b in zip(*[batch.column(c).to_pylist() for c in ("chunk", "n", "a", "b")], strict=True):
                _, ids, data, offsets = open_chunk(n, a, b)
                trigger, phrase, row, start, count = phrases_of(data, offsets, window, gram)
                if not len(trigger):
                    continue
                order, head = first_of([start, row, ids[row], phrase, trigger])
                # Copies inside a chunk are known to be later ones here; a frequent phrase leaves a chunk once.
                again = order[~head]
                out = []
                if len(again):
                    places = np.zeros(len(again), dtype=PLACE)
                    places["row"], places["start"], places["n"] = row[again], start[again], count[again]
                    out.append((2, chunk % parts, chunk, len(again), pack_rows(places), b""))
                kept = order[head]
                part = ((trigger[kept] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.flatnonzero(np.diff(part)) + 1
                for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kept)], strict=True):
                    k = kept[low:high]
                    own = np.zeros(len(k), dtype=PHRASE)
                    own["hash"], own["id"], own["row"], own["start"], own["n"] = phrase[k] >> np.uint64(24), ids[row[k]], row[k], start[k], count[k]
                    out.append((1, int(part[low]), chunk, len(k), pack64(trigger[k]), pack_rows(own)))
                yield from emit(out)

    return deal


def by_chunk(kind: int, chunk: np.ndarray, places: np.ndarray, triggers: np.ndarray | None = None) -> list[tuple]:
    order = np.argsort(chunk, kind="stable")
    chunk, places = chunk[order], places[order]
    more = (lambda a, b: b"") if triggers is None else (lambda a, b: pack_flat(triggers[order][a:b], "<u8"))
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    return [(kind, 0, int(chunk[a]), b - a, pack_rows(places[a:b]), more(a, b)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)], strict=True)] if len(chunk) else []


def rank_fn(many: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Later copies of a phrase go; of triggers with several phrases, the first place of each is to be compared."""
        for _, rows in groups(batches, "part"):
            out, triggers, own, chunks = [], [], [], []
            for kind, chunk, n, a, b in zip(*[rows.column(c).to_pylist() for c in ("kind", "chunk", "n", "a", "b")], strict=True):
                if kind == 2:
                    out.append((2, 0, chunk, n, a, b""))
                else:
                    triggers.append(unpack64(a, n))
                    own.append(unpack_rows(b, n, PHRASE))
                    chunks.append(np.full(n, chunk))
            if triggers:
                t, p, c = np.concatenate(triggers), np.concatenate(own), np.concatenate(chunks)
                order, head = first_of([p["start"], p["row"], c, p["id"], p["hash"], t])
                t, p, c = t[order], p[order], c[order]
                places = np.zeros(len(p), dtype=PLACE)
                for f in ("row", "start", "n"):
                    places[f] = p[f]
                out += by_chunk(2, c[~head], places[~head])
                t, c, places = t[head], c[head], places[head]
                begins = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.empty(0, np.int64)
                sizes = np.diff(np.append(begins, len(t)))
                several = np.repeat(sizes, sizes)
                for kind, which in ((3, (several > 1) & (several <= many)), (5, several > max(many, 1))):
                    out += by_chunk(kind, c[which], places[which], t[which])
            yield from emit(out)

    return rank


def dealt_bounds(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Part, begin and end of runs of ascending keys that go to one part."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True) if len(keys) else ():
        yield int(part[low]), low, high


def fetch_fn(parts: int, window: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the phrases to compare, dealt by trigger; of triggers with many phrases the windows, by their hash."""
        for chunk, rows in groups(batches, "chunk"):
            texts, wanted, triggers = None, {3: [], 5: []}, []
            for kind, n, a, b in zip(*[rows.column(c).to_pylist() for c in ("kind", "n", "a", "b")], strict=True):
                if kind == 0:
                    texts = (n, a, b)
                else:
                    wanted[kind].append(unpack_rows(a, n, PLACE))
                    if kind == 3:
                        triggers.append(unpack_flat(b, n, "<u8"))
            if not wanted[3] and not wanted[5]:
                continue
            _, ids, data, offsets = open_chunk(*texts)
            out = []
            if wanted[3]:
                w, trigger = np.concatenate(wanted[3]), np.concatenate(triggers)
                start, n = offsets[w["row"]] + w["start"], w["n"].astype(np.int64)
                order = np.argsort(trigger)
                w, start, n = w[order], start[order], n[order]
                for part, low, high in dealt_bounds(trigger[order], parts):
                    own = np.zeros(high - low, dtype=PHRASE)
                    x = w[low:high]
                    own["id"], own["row"], own["start"], own["n"] = ids[x["row"]], x["row"], x["start"], x["n"]
                    raw = data[B.ranges(start[low:high], n[low:high] + window - 1)].tobytes()
                    out.append((4, part, chunk, high - low, pack_rows(own), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)))
            if wanted[5]:
                w = np.concatenate(wanted[5])
                n = w["n"].astype(np.int64)
                row, start = np.repeat(w["row"], n), B.ranges(w["start"].astype(np.int64), n)
                at = offsets[row] + start
                own = np.zeros(len(at), dtype=PHRASE)
                own["hash"], own["id"], own["row"], own["start"], own["n"] = B.span_hashes(B.prefix_sums(data), at, at + window), ids[row], row, start, 1
                order, head = first_of([own["start"], own["row"], own["id"], np.zeros(len(own), np.int8), own["hash"]])
                again = own[order[~head]]  # copies in the chunk are later ones already
                if len(again):
                    places = np.zeros(len(again), dtype=PLACE)
                    places["row"], places["start"], places["n"] = again["row"], again["start"], 1
                    out.append((2, chunk % parts, chunk, len(again), pack_rows(places), b""))
                own = own[order[head]]
                for part, low, high in dealt_bounds(own["hash"], parts):
                    out.append((6, part, chunk, high - low, pack_rows(own[low:high]), b""))
            yield from emit(out)

    return fetch


def ranks_of(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    step = np.empty(len(keys), dtype=np.int64)
    step[:1] = 0
    step[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the suffix at each place but the last depth - 1, by its first `depth` bytes."""
    n = len(data) - depth + 1
    h = min(depth, 8)
    key = np.zeros(len(data) - h + 1, dtype=np.uint64)
    for k in range(h):
        key = (key << np.uint64(8)) | data[k : len(data) - h + 1 + k]
    ranks = ranks_of(key)
    while h < depth:
        step = min(h, depth - h)  # the last step overlaps
        ranks = ranks_of(ranks[: len(ranks) - step] * (len(ranks) + 1) + ranks[step:])
        h += step
    return ranks[:n]


def compare_fn(window: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of different phrases of one trigger, in the order of their suffixes: all but the first of equal ones go."""
        for _, rows in groups(batches, "part"):
            own, chunks, raw, single, single_chunks, out = [], [], [], [], [], []
            for kind, chunk, n, a, b in zip(*[rows.column(c).to_pylist() for c in ("kind", "chunk", "n", "a", "b")], strict=True):
                if kind == 2:
                    out.append((2, 0, chunk, n, a, b""))
                elif kind == 6:
                    single.append(unpack_rows(a, n, PHRASE))
                    single_chunks.append(np.full(n, chunk))
                else:
                    own.append(unpack_rows(a, n, PHRASE))
                    chunks.append(np.full(n, chunk))
                    raw.append(pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True))
            gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunk, row, start
            if own:
                p, c = np.concatenate(own), np.concatenate(chunks)
                n = p["n"].astype(np.int64)
                ends = np.cumsum(n + window - 1)
                at = B.ranges(ends - (n + window - 1), n)
                rank = suffix_ranks(np.frombuffer(b"".join(raw), dtype=np.uint8), window)[at]
                which = np.repeat(np.arange(len(p)), n)
                start = p["start"][which].astype(np.int64) + B.ranges(np.zeros(len(n), np.int64), n)
                order, head = first_of([start, p["row"][which], c[which], p["id"][which], np.zeros(len(which), np.int8), rank])
                later = order[~head]
                gone.append((c[which[later]], p["row"][which[later]], start[later]))
            if single:
                p, c = np.concatenate(single), np.concatenate(single_chunks)
                order, head = first_of([p["start"], p["row"], c, p["id"], np.zeros(len(p), np.int8), p["hash"]])
                later = order[~head]
                gone.append((c[later], p["row"][later], p["start"][later]))
            if gone:
                chunk, row, start = (np.concatenate(x) for x in zip(*gone, strict=True))
                by = np.lexsort((start, row, chunk))
                chunk, row, start = chunk[by], row[by], start[by]
                if len(chunk):  # neighbours join
                    head = np.ones(len(chunk), dtype=bool)
                    head[1:] = (chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
                    heads = np.flatnonzero(head)
                    joined = np.zeros(len(heads), dtype=PLACE)
                    joined["row"], joined["start"], joined["n"] = row[heads], start[heads], np.diff(np.append(heads, len(chunk)))
                    out += by_chunk(2, chunk[heads], joined)
            yield from emit(out)

    return compare


RESULT = "doc_id long, n_bytes long, spans array<long>, kept binary"


def remove_fn(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "chunk"):
            texts, gone = None, []
            for kind, n, a, b in zip(*[rows.column(c).to_pylist() for c in ("kind", "n", "a", "b")], strict=True):
                if kind == 0:
                    texts = (n, a, b)
                else:
                    gone.append(unpack_rows(a, n, PLACE))
            ids, _, data, offsets = open_chunk(*texts)
            size = len(offsets) - 1
            hit = np.zeros(len(data), dtype=bool)
            if gone:
                w = np.concatenate(gone)
                start = offsets[w["row"]] + w["start"]
                hit = B.covered(start, start + w["n"] + window - 1, len(data))
            starts, ends, row = B.runs(hit, offsets)
            spans = np.stack([starts - offsets[row], ends - offsets[row]], axis=1).ravel()
            per_row = np.bincount(row, minlength=size)
            left = np.concatenate([[0], np.cumsum(~hit)])[offsets]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~hit].tobytes())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * per_row)]), pa.int32()), pa.array(spans, pa.int64())), kept.cast(pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return remove


def dedup_substrings(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, slab: int = B.SLAB, many: int = MANY_PHRASES) -> DataFrame:
    """doc_id, n_bytes, spans, kept of every document row: the removed byte runs [s, e, s, e, ...] and the bytes that stay.

    A byte goes if a window of equal bytes that covers it also starts earlier, in a smaller id or earlier in the same
    document; windows never cross documents and are judged on the input. Null and empty texts have no bytes. Rows of one
    id follow one another in the order of the written chunks; null ids come first. Kept bytes may begin or end inside a
    character. Texts are taken whole at any length. Empty tables give an empty result; other columns are ignored.
    """
    need(documents, id_col, text_col)
    if not 0 < gram <= window:
        raise ValueError("gram is between 1 and window")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    chunks = cut(docs.mapInArrow(chunk_fn(slab), ROWS), "chunks")
    tasks = max(2, docs.rdd.getNumPartitions())
    parts = 4 * tasks

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(tasks, key).sortWithinPartitions(key)

    flags = cut(dealt(chunks.mapInArrow(deal_fn(parts, window, gram), ROWS), "part").mapInArrow(rank_fn(many), ROWS), "phrases")
    wanted = dealt(chunks.unionAll(flags.where("kind IN (3, 5)")), "chunk").mapInArrow(fetch_fn(parts, window), ROWS)
    more = cut(dealt(wanted, "part").mapInArrow(compare_fn(window), ROWS), "windows")
    return dealt(chunks.unionAll(flags.where("kind = 2")).unionAll(more), "chunk").mapInArrow(remove_fn(window), RESULT)
