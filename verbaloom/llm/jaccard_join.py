"""Exact n-gram Jaccard join by multiple-global-order filtering, and its connected classes.

1. Each document becomes its set of word shingles, hashed. Equal sets form one class, which its smallest id represents.
2. Shingles are dealt by hash, so one task knows how many documents hold each; what reaches it are packed, sorted blocks.
   Only shingles of two documents or more go back to their documents: no other can be shared.
3. Under an order by rarity, two sets of Jaccard similarity t can only link if their first |x| - ceil(t |x|) + 1 shingles
   share one. Shingles of a single document come first and fill most prefixes, so few documents have anything to probe.
4. The first order makes candidates. A candidate pair must also share a prefix shingle under each further order, which
   breaks ties and groups counts in its own way; only pairs that pass all filters and the length filter are verified.
5. A shingle's documents are never paired with each other at large. Each round takes a few of them as pivots and tests these
   against those in other components; components merge, lists within one component are done, and pivots tested
   leave their list. The rounds end when no list spans two components: then every link lies inside a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, free_name, need, release
from .graph import components

SHINGLE_WORDS = 5
THRESHOLD = 80
SLAB = 1 << 20
#: The most pivots a list has in a round; Spark picks so few in each task before it shuffles them.
MAX_PIVOTS = 1_000

DEALT = "kind int, part long, chunk long, a binary, b binary, n long"


def pack64(x: np.ndarray) -> bytes:
    """Byte planes of ascending integers' differences; small and sorted values compress well."""
    x = np.ascontiguousarray(x, dtype="<u8")
    steps = np.diff(x, prepend=np.uint64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack64(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd"), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_flat(x: np.ndarray, dtype: str) -> bytes:
    x = np.ascontiguousarray(x, dtype=dtype)
    return pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpack_flat(blob: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=size * n, codec="zstd"), dtype=np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows of one key in batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = batch.column(column).to_numpy()
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if held and keys[low] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = int(keys[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield key, pa.Table.from_batches(held)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) pairs, by row; a text of fewer words has its whole sequence as one shingle."""
    h, rows, _, _ = B.word_hashes(B.LOWER[data], offsets, B.NOT_SPACE)
    if not len(h):
        return rows, h
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    firsts = np.cumsum(counts) - counts
    values, owners = [], []
    if len(h) >= k:
        whole = np.flatnonzero(rows[k - 1 :] == rows[: len(rows) - k + 1])
        values.append(B.chain(h, k)[whole])
        owners.append(rows[whole])
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            values.append(B.mix(B.chain(h, m)[firsts[short]] + np.uint64(m)))
            owners.append(short)
    return B.unique_within(np.concatenate(owners), np.concatenate(values))


def deal_fn(parts: int, k: int, slab: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for low, high, data, offsets in B.slabs(batch.column(1), slab):
                rows, values = shingles(data, offsets, k)
                n = high - low
                counts = np.bincount(rows, minlength=n).astype(np.int64)
                heads = np.minimum(np.cumsum(counts) - counts, max(len(values) - 1, 0))
                none = counts == 0
                signs = []
                for salt in (0x51ED27, 0xA3C59A):
                    s = np.add.reduceat(B.mix(values ^ np.uint64(salt)), heads) if len(values) else np.zeros(n, np.uint64)
                    signs.append(np.where(none, np.uint64(0), s).view(np.int64))
                order = np.argsort(values)
                values, owner = values[order], rows[order]
                bucket = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                bounds = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)) if len(values) else []
                docs = pa.RecordBatch.from_arrays([ids.slice(low, n), pa.array(counts), pa.array(signs[0]), pa.array(signs[1])], names=["id", "n", "s1", "s2"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema) as w:
                    w.write_batch(docs)
                out = [(0, chunk % parts, chunk, sink.getvalue().to_pybytes(), b"", n)]
                out += [(1, int(bucket[a]), chunk, pack64(values[a:b]), pack_flat(owner[a:b], "<u4"), b - a) for a, b in bounds]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["kind", "part", "chunk", "a", "b", "n"])
                chunk += 1

    return deal


def count_fn():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part: which shingles two documents or more hold, back to the chunks they came from."""
        names = ["kind", "part", "chunk", "a", "b", "n"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        for part, rows in groups(batches, "part"):
            out = []
            values, owners, chunks = [], [], []
            for kind, chunk, a, b, n in zip(rows.column("kind").to_pylist(), rows.column("chunk").to_pylist(), rows.column("a"), rows.column("b"), rows.column("n").to_pylist(), strict=True):
                if kind == 0:
                    out.append((0, part, chunk, a.as_py(), b"", n))
                else:
                    values.append(unpack64(a.as_py(), n))
                    owners.append(unpack_flat(b.as_py(), n, "<u4"))
                    chunks.append(np.full(n, chunk, dtype=np.int64))
            if values:
                v, own, ch = np.concatenate(values), np.concatenate(owners), np.concatenate(chunks)
                order = np.argsort(v)
                v = v[order]
                head = np.ones(len(v), dtype=bool)
                head[1:] = v[1:] != v[:-1]
                token = np.cumsum(head) - 1
                held = np.bincount(token)[token]
                shared = held > 1
                token, held, own, ch = token[shared], held[shared], own[order][shared], ch[order][shared]
                by = np.lexsort((token, ch))
                token, held, own, ch = token[by], held[by], own[by], ch[by]
                cuts = np.flatnonzero(np.diff(ch)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ch)], strict=True) if len(ch) else ():
                    packed = pack_flat(own[a:b], "<u4")
                    out.append((1, part, int(ch[a]), pack64(token[a:b]), len(packed).to_bytes(4, "little") + packed + pack_flat(np.minimum(held[a:b], 2**32 - 1), "<u4"), b - a))
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 256], strict=True), kinds, strict=True)], names=names)

    return count


SETS = "doc_id long, n long, s1 long, s2 long, n_shared long, tokens binary, held binary, probes array<long>"


def prefix(tokens: np.ndarray, held: np.ndarray, n: int, order: int, threshold: int) -> np.ndarray:
    """The shared shingles in the prefix of a set of n under one of three orders; shingles of one document come before them."""
    size = n - -(-threshold * n // 100) + 1 - (n - len(tokens))
    if size <= 0:
        return tokens[:0]
    if order == 0:
        by = np.lexsort((tokens, held))
    elif order == 1:
        by = np.lexsort((B.mix(tokens + np.uint64(0x1F3D)), held))
    else:
        by = np.lexsort((B.mix(tokens + np.uint64(0xB7E1)), np.frexp(held.astype(np.float64))[1]))
    return tokens[by[:size]]


def gather_fn(threshold: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk: its documents with their shared shingles and what they probe under the first order."""
        for _, rows in groups(batches, "chunk"):
            docs, tokens, owners, holds = None, [], [], []
            for kind, part, a, b, n in zip(rows.column("kind").to_pylist(), rows.column("part").to_pylist(), rows.column("a"), rows.column("b"), rows.column("n").to_pylist(), strict=True):
                if kind == 0:
                    docs = pa.ipc.open_stream(a.as_py()).read_all().combine_chunks()
                else:
                    raw = b.as_py()
                    cutoff = 4 + int.from_bytes(raw[:4], "little")
                    tokens.append(unpack64(a.as_py(), n) + np.uint64(part << 32))
                    owners.append(unpack_flat(raw[4:cutoff], n, "<u4"))
                    holds.append(unpack_flat(raw[cutoff:], n, "<u4"))
            size = docs.num_rows
            if tokens:
                t, own, held = np.concatenate(tokens), np.concatenate(owners).astype(np.int64), np.concatenate(holds)
                by = np.lexsort((t, own))
                t, own, held = t[by], own[by], held[by]
                first = np.ones(len(t), dtype=bool)
                first[1:] = (t[1:] != t[:-1]) | (own[1:] != own[:-1])
                t, own, held = t[first], own[first], held[first]
            else:
                t, own, held = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32)
            counts = np.bincount(own, minlength=size)
            firsts = np.cumsum(counts) - counts
            n_all = docs.column("n").to_numpy()
            blobs, helds, probes = [None] * size, [None] * size, [None] * size
            for i in np.flatnonzero((counts > 0) & (n_all - -(-threshold * n_all // 100) + 1 > n_all - counts)).tolist():
                a, b = int(firsts[i]), int(firsts[i] + counts[i])
                blobs[i], helds[i] = pack64(t[a:b]), pack_flat(held[a:b], "<u4")
                probes[i] = prefix(t[a:b], held[a:b], int(n_all[i]), 0, threshold).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [docs.column("id").combine_chunks(), docs.column("n").combine_chunks(), docs.column("s1").combine_chunks(), docs.column("s2").combine_chunks(), pa.array(counts), pa.array(blobs, pa.binary()), pa.array(helds, pa.binary()), pa.array(probes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "n_shared", "tokens", "held", "probes"],
            )

    return gather


def verify_fn(threshold: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that share a prefix shingle under both further orders and meet the threshold."""
        for batch in batches:
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("nx", "mx", "tx", "hx", "ny", "my", "ty", "hy")]
            held: tuple = (None, None)
            for i, (nx, mx, tx, hx, ny, my, ty, hy) in enumerate(zip(*columns, strict=True)):
                if held[0] is not tx:
                    x, hold = unpack64(tx, mx), unpack_flat(hx, mx, "<u4")
                    held = (tx, [x] + [prefix(x, hold, nx, o, threshold) for o in (1, 2)])
                y, hold = unpack64(ty, my), unpack_flat(hy, my, "<u4")
                x, *further = held[1]
                if all(len(np.intersect1d(p, prefix(y, hold, ny, o, threshold), assume_unique=True)) for o, p in zip((1, 2), further, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= threshold * (nx + ny - both):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("x", "y")], names=["x", "y"])

    return verify


def shingle_sets(documents: DataFrame, *, id_col: str, text_col: str, k: int, threshold: int, slab: int = SLAB) -> DataFrame:
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    parts = 4 * max(2, docs.rdd.getNumPartitions())
    tasks = max(2, parts // 4)
    dealt = docs.mapInArrow(deal_fn(parts, k, slab), DEALT).repartition(tasks, "part").sortWithinPartitions("part")
    counted = dealt.mapInArrow(count_fn(), DEALT).repartition(tasks, "chunk").sortWithinPartitions("chunk")
    return cut(counted.mapInArrow(gather_fn(threshold), SETS), "shingle-sets")


def find_links(sets: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of the classes that link with another; nodes are the smallest ids of the classes.

    A list, the documents under one shingle, is never gathered in a task: what a round has to know of lists is aggregated
    and joined back, and the joins are plain ones that Spark splits at a long list.
    """
    probing = sets.where("probes IS NOT NULL")
    nodes = cut(probing.select("doc_id", "n", F.col("n_shared").alias("m"), "tokens", "held"), "jaccard-nodes")
    lists = probing.select("doc_id", "n", F.col("n_shared").alias("m"), F.posexplode("probes").alias("i", "token"))
    lists = cut(lists.select("doc_id", "n", "m", (F.col("n") - F.col("m") + F.col("i")).alias("at"), "token", F.col("doc_id").alias("c")), "jaccard-lists")
    # What two sets of these sizes have to share, and so how far into either the first shared shingle can lie.
    overlap = lambda a, b: F.ceil(threshold * (a + b) / (100 + threshold))
    labels = links = tested = None
    turn = 0
    while True:
        # Lists within one component are done.
        stats = cut(lists.groupBy("token").agg(F.min("n").alias("least"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").drop("low", "high"), "jaccard-stats")
        if stats.isEmpty():
            break
        state = lists.join(stats, "token").withColumn("least", F.greatest("least", F.ceil(threshold * F.col("n") / 100)))
        # Two sets share at most what either shares with any other, and the first shared shingle comes early in both.
        state = state.where((F.col("m") >= overlap(F.col("n"), F.col("least"))) & (F.col("at") <= F.col("n") - overlap(F.col("n"), F.col("least"))))
        state = cut(state.drop("least"), "jaccard-state")
        # Pivots: members of the components with the fewest members in the list, more of them each round; first those with
        # the smallest share of shingles of their own, as the original of many copies has.
        members = cut(state.groupBy("token", "c").agg(F.count(F.lit(1)).alias("members")), "jaccard-members")
        first = Window.partitionBy("token").orderBy("members", F.col("n") / F.col("m"), "c", "doc_id")
        chosen = state.join(members, ["token", "c"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= min(4**turn, MAX_PIVOTS))
        pivots = cut(chosen.select("token", F.col("doc_id").alias("p"), F.col("n").alias("np"), F.col("m").alias("mp"), F.col("at").alias("ap"), F.col("c").alias("cp")), "jaccard-pivots")
        need_both = overlap(F.col("n"), F.col("np"))
        reach = (F.least("m", "mp") >= need_both) & (F.col("at") <= F.col("n") - need_both) & (F.col("ap") <= F.col("np") - need_both)
        pairs = state.join(pivots, "token").where((F.col("c") != F.col("cp")) & (100 * F.least("n", "np") >= threshold * F.greatest("n", "np")) & reach)
        pairs = pairs.select(F.least("doc_id", "p").alias("x"), F.greatest("doc_id", "p").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = cut(pairs, "jaccard-pairs")
        side = lambda s: nodes.select(F.col("doc_id").alias(s), *[F.col(a).alias(b + s) for a, b in (("n", "n"), ("m", "m"), ("tokens", "t"), ("held", "h"))])
        found = cut(pairs.join(side("y"), "y").join(side("x"), "x").mapInArrow(verify_fn(threshold), "x long, y long"), "jaccard-links")
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = found if links is None else links.unionAll(found)
        left = state.join(pivots.select("token", F.col("p").alias("doc_id")), ["token", "doc_id"], "left_anti").drop("c")
        if not found.isEmpty():
            release(labels)
            labels = cut(components(links, "x", "y"), "jaccard-labels")
        if labels is None:
            after = left.withColumn("c", F.col("doc_id"))
        else:
            after = left.join(labels, left.doc_id == labels.node, "left").select("doc_id", "n", "m", "at", "token", F.coalesce("component", "doc_id").alias("c"))
        after = cut(after.select("doc_id", "n", "m", "at", "token", "c"), "jaccard-lists")
        release(lists, stats, state, members, pivots)
        lists = after
        turn += 1
    release(lists, stats, nodes)
    if labels is None:
        return sets.sparkSession.createDataFrame([], "node long, component long")
    return labels


def link_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, threshold: int = THRESHOLD, slab: int = SLAB) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row, component_id the smallest id that links reach.

    Words are lower-cased in A-Z and split at ASCII white space. Two rows link when 100 * shared >= threshold * union.
    Null and empty texts have no shingles and link with nothing. Rows of one id are joined as if they were one document
    wherever their sets link. A row with a null id joins nothing. Empty tables give an empty result; other columns are
    ignored. Shingles are told apart by 64-bit hashes.
    """
    need(documents, id_col, text_col)
    sets = shingle_sets(documents, id_col=id_col, text_col=text_col, k=k, threshold=threshold, slab=slab)
    light = sets.select("doc_id", "n", "s1", "s2")
    full = light.where("n > 0")
    # Read back, both sides of the join are plain exchanges, which Spark splits at a large class.
    classes = cut(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "jaccard-classes")
    several = classes.where("size > 1 AND rep IS NOT NULL").drop("size")
    members = cut(full.join(several, ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "jaccard-members")
    alone = members.where("doc_id = rep").select("doc_id").distinct()
    probing = sets.where("probes IS NOT NULL").join(alone, "doc_id", "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    labels = find_links(probing, threshold)
    linked = members.join(labels, members.rep == labels.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return linked.unionAll(light.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(documents: DataFrame, **options) -> DataFrame:
    """One document of each class: the one with the smallest id; rows with a null id stay. Columns as they came."""
    id_col = options.get("id_col", "doc_id")
    name = free_name(documents, "__later")
    later = link_documents(documents, **options).where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(later, documents[id_col].cast("long") == F.col(name), "left_anti")
