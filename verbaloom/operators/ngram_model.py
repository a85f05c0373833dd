"""A naive Bayes language model over character trigrams, counted and applied in Arrow batches.

Training counts trigrams by language inside each task and shuffles only these counts. A model of bounded size is
broadcast as arrays; each row is then scored where it stands, with no shuffle, in batches and in streams. A larger
model stays a table of a row per trigram, and its scores come from a join with each document's distinct trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.arrow_text import row_sums, slices, windows

#: A trigram at each code point, by look-ahead; linear in the text.
TRIGRAM = r"(?s)(?=(...))."
MAX_LANGUAGES = 2_000
#: Trigrams times languages of a model that may be collected and broadcast: 64 MB of weights.
MAX_CELLS = 8 << 20
#: Alphabets up to this size are looked up in a dense table of trigrams (64 MB at most), others by bisection.
DENSE_ALPHABET = 255
SLICE_BYTES = 1 << 20
SCORES = "array<struct<language:string,score:double>>"
_SCORE = pa.list_(pa.struct([("language", pa.string()), ("score", pa.float64())]))


def trigrams(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TRIGRAM), 1)


def keys_of(points: np.ndarray) -> np.ndarray:
    """Three code points of 21 bits in one integer, for each place but the last two."""
    p = points.astype(np.int64)
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, key, n): one row for each language and trigram of the task, or of some 2 million of them."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for language, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["language", "key", "n"])

    for batch in batches:
        names, codes = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
        for low, high, points, offsets in slices(batch.column(1), SLICE_BYTES):
            if len(points) < 3:
                continue
            keys = keys_of(points)
            whole = windows(offsets, len(points), 3)[: len(keys)]
            owner = np.repeat(codes[low:high], np.diff(offsets))[: len(keys)]
            for c in np.unique(codes[low:high]).tolist():
                found = np.unique(keys[whole & (owner == c)], return_counts=True)
                held.setdefault(names[c], []).append(found)
                size += len(found[0])
        if size > 2_000_000:
            for language, parts in held.items():
                held[language] = [merged(parts)]
            size = sum(len(p[0][0]) for p in held.values())
            if size > 1_000_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


class Arrays:
    """A model on a worker: which weights a trigram has."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, priors: np.ndarray) -> None:
        self.keys, self.priors = keys, priors
        self.weights = np.concatenate([weights, np.zeros((1, len(priors)))])  # the last row is for unknown trigrams
        letters = np.unique(np.concatenate([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF]))
        self.dense = None
        if len(letters) <= DENSE_ALPHABET:
            self.letter = np.zeros(0x110000, dtype=np.int32)
            self.letter[letters] = np.arange(1, len(letters) + 1)
            self.base = len(letters) + 1
            self.dense = np.full(self.base**3, len(keys), dtype=np.int32)
            a, b, c = (self.letter[x] for x in (keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF))
            self.dense[(a * self.base + b) * self.base + c] = np.arange(len(keys))

    def found(self, points: np.ndarray) -> np.ndarray:
        """The row of weights of the trigram at each place but the last two."""
        if self.dense is not None:
            x = self.letter[points]
            return self.dense[(x[:-2] * self.base + x[1:-1]) * self.base + x[2:]]
        keys = keys_of(points)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(len(keys), np.int64)

    def sums(self, texts: pa.Array) -> np.ndarray:
        """A row of summed log-probabilities with the priors for each text."""
        out = np.tile(self.priors, (len(texts), 1))
        for low, high, points, offsets in slices(texts, max(1 << 14, SLICE_BYTES * 4 // max(len(self.priors), 1))):
            rows = np.full(len(points), len(self.keys), dtype=np.int64)
            if len(points) > 2:
                rows[:-2] = self.found(points)
            rows[~windows(offsets, len(points), 3)] = len(self.keys)
            out[low:high] += row_sums(self.weights[rows], offsets)
        return out


def lists(values: np.ndarray, null: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as Arrow lists; null where told."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()), mask=pa.array(null))


@dataclass(frozen=True)
class NgramModel:
    """languages in axis order; priors in axis order; weights(gram, logp array<double>), and as arrays if they are few."""

    languages: tuple[str, ...]
    priors: tuple[float, ...]
    weights: DataFrame
    arrays: object | None = None  # a broadcast of (keys, weights)

    @property
    def table(self) -> DataFrame:
        names = F.array(*[F.lit(x) for x in self.languages or ("",)])
        return self.weights.select("gram", F.posexplode("logp").alias("axis", "logp")).withColumn("language", F.element_at(names, F.col("axis") + 1))

    def release(self) -> None:
        """Frees what the model holds on the cluster."""
        if self.arrays is not None:
            self.arrays.unpersist()
        self.weights.unpersist()

    def sums_column(self, text: Column) -> Column:
        """array<double>: the score of each language in axis order; null texts have null."""
        sent, priors = self.arrays, np.array(self.priors)

        @F.arrow_udf("array<double>")
        def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = Arrays(*sent.value, priors)
            for texts in batches:
                yield lists(model.sums(texts), texts.is_null().to_numpy(zero_copy_only=False))

        return sums(F.lower(text))

    def scores_column(self, text: Column, top: int | None = None) -> Column:
        """array<struct<language, score>>: softmax probabilities, best first, the axis breaking ties; the first `top` of them."""
        sent, priors, names = self.arrays, np.array(self.priors), pa.array(self.languages, pa.string())

        @F.arrow_udf(SCORES)
        def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = Arrays(*sent.value, priors)
            for texts in batches:
                s = model.sums(texts)
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                order = np.argsort(-p, axis=1, kind="stable")[:, :top]
                flat = pa.StructArray.from_arrays([names.take(pa.array(order.ravel())), pa.array(np.take_along_axis(p, order, axis=1).ravel())], names=["language", "score"])
                ends = pa.array(np.arange(len(p) + 1) * order.shape[1], pa.int32())
                yield pa.ListArray.from_arrays(ends, flat, mask=texts.is_null()).cast(_SCORE)

        return ranked(F.lower(text))

    def scores(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, language, axis, score): summed log-probabilities of known trigrams plus the prior, for every row of df."""
        if not self.languages:
            raise ValueError("the model was trained on no labelled rows")
        names = F.array(*[F.lit(x) for x in self.languages])
        if self.arrays is not None:
            wide = df.select(id_col, F.posexplode(self.sums_column(F.coalesce(text_col, F.lit("")))).alias("axis", "score"))
            return wide.select(id_col, F.element_at(names, F.col("axis") + 1).alias("language"), "axis", "score")
        grams = df.select(id_col, F.explode(trigrams(F.col(text_col))).alias("gram")).groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("n"))
        found = grams.join(self.weights, "gram")
        sums = found.groupBy(id_col).agg(*[F.sum(F.col("n") * F.col("logp")[i]).alias(f"s{i}") for i in range(len(self.languages))])
        wide = df.select(id_col).distinct().join(sums, id_col, "left")
        entries = F.array(*[(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.lit(p)) for i, p in enumerate(self.priors)])
        return wide.select(id_col, F.posexplode(entries).alias("axis", "score")).select(id_col, F.element_at(names, F.col("axis") + 1).alias("language"), "axis", "score")

    def ranked(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, scores): softmax probabilities as array<struct<language, score>>, best first, the axis breaking ties."""
        if self.arrays is not None and self.languages:
            return df.select(id_col, self.scores_column(F.coalesce(text_col, F.lit(""))).alias("scores"))
        logs = self.scores(df, id_col, text_col)
        rows = logs.groupBy(id_col).agg(F.max("score").alias("top"), F.collect_list(F.struct("language", "axis", "score")).alias("all"))
        weights = F.transform("all", lambda x: F.struct((-F.exp(x.score - F.col("top"))).alias("w"), x.axis.alias("axis"), x.language.alias("language")))
        rows = rows.withColumn("all", F.array_sort(weights)).withColumn("sum", F.aggregate("all", F.lit(0.0), lambda a, x: a - x.w))
        return rows.select(id_col, F.transform("all", lambda x: F.struct(x.language.alias("language"), (-x.w / F.col("sum")).alias("score"))).alias("scores"))


def gram_of(key: Column) -> Column:
    """The three characters of a key."""
    letter = lambda shift: F.decode(F.unhex(F.lpad(F.hex(F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(0x1FFFFF))), 8, "0")), "UTF-32")
    return F.concat(letter(42), letter(21), letter(0))


def train(df: DataFrame, text_col: str, label_col: str, max_cells: int = MAX_CELLS) -> NgramModel:
    """Add-one smoothing over the trigrams that any language has; rows without a label don't count.

    A model of more than max_cells weights stays a cached table until release().
    """
    labelled = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("language"), F.col(text_col).alias("text"))
    sizes = labelled.groupBy("language").agg(F.count(F.lit(1)).alias("docs")).orderBy("language").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    names = tuple(r.language for r in sizes)
    docs = sum(r.docs for r in sizes)
    priors = tuple(log(r.docs / docs) for r in sizes)
    counted = labelled.select("language", F.lower("text").alias("text")).mapInArrow(count_batches, "language string, key long, n long")
    by_language = [F.sum(F.when(F.col("language") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(names)]
    wide = counted.groupBy("key").agg(F.sum("n").alias("n"), *by_language).persist()
    totals = wide.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(names))]).first()
    v = totals.v or 0
    spark = df.sparkSession
    if v * max(len(names), 1) <= max_cells:
        found = wide.toArrow().combine_chunks()
        wide.unpersist()
        keys = found.column("key").to_numpy()
        order = np.argsort(keys)
        n = np.stack([found.column(f"n{i}").to_numpy() for i in range(len(names))], axis=1)[order] if names else np.zeros((v, 0))
        keys, logs = keys[order], np.log((n + 1.0) / (n.sum(axis=0) + v)) if v else n.astype(float)
        grams = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        rows = pa.table({"gram": pa.array([grams[i : i + 3] for i in range(0, 3 * v, 3)], pa.string()), "logp": lists(logs, np.zeros(v, bool)) if v else pa.array([], pa.list_(pa.float64()))})
        return NgramModel(names, priors, spark.createDataFrame(rows), spark.sparkContext.broadcast((keys, logs)))
    logs = [F.log((F.col(f"n{i}") + 1.0) / F.lit(float(totals[f"t{i}"] + v))) for i in range(len(names))]
    return NgramModel(names, priors, wide.select(gram_of(F.col("key")).alias("gram"), F.array(*logs).alias("logp")).persist())
