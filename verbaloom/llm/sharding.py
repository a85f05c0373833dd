"""Size-tiered compaction of an append-only document store, in DataFrame writes and file renames only.

    store/data/<run>/part-*.parquet     immutable shards
    store/manifest/v0000000012.json     one file for each version: the shards that make it up

An append writes a run of small shards and commits a version that adds them. Compaction sorts the shards into tiers by
size, each fan_in times as large as the one below; a tier with fan_in shards or more is read back and rewritten in files of
about the target size, and a version that swaps them in is committed. Shards of the target size are left alone, so each
row is rewritten about log(target / smallest, fan_in) times. A commit is a rename that fails if the version exists:
of two writers one wins, and the other reads the new version and tries again. HDFS makes such a rename in one step; a local
disk or an object store looks first and moves then, so there a store is for one writer at a time. Readers see whole versions only; a job that
fails or loses executors leaves files that no version names, and vacuum() removes these.

The driver holds a line per shard, never rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hadoop_path, need

TARGET_BYTES = 128 << 20
FAN_IN = 4
SMALLEST_BYTES = 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, smallest_bytes: int = SMALLEST_BYTES) -> None:
        if fan_in < 2 or target_bytes < smallest_bytes:
            raise ValueError("fan_in is at least 2 and the target at least the smallest size")
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.smallest_bytes = target_bytes, fan_in, smallest_bytes
        for sub in ("data", "manifest"):
            fs, p = hadoop_path(spark, f"{self.path}/{sub}")
            fs.mkdirs(p)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:010d}.json"

    def version(self) -> int:
        """The latest version; 0 is the empty store."""
        fs, p = hadoop_path(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = hadoop_path(self.spark, self._manifest(version))
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(s["path"], s["size"]) for s in self.manifest(version)["shards"]]

    def commit(self, after: int, schema: str, shards: list[Shard]) -> int:
        """Writes the version that follows `after`: a hidden file first, then a rename that never replaces."""
        version = after + 1
        body = json.dumps({"version": version, "schema": schema, "shards": [s.__dict__ for s in shards]}).encode()
        fs, hidden = hadoop_path(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(body))
        out.close()
        _, final = hadoop_path(self.spark, self._manifest(version))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        try:
            renames = self.spark.sparkContext._gateway.new_array(none, 1)
            renames[0] = none.NONE
            context.rename(hidden, final, renames)
        except Exception as e:
            fs.delete(hidden, False)
            if fs.exists(final):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _write(self, df: DataFrame) -> list[Shard]:
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(run)
        return self._files(run)

    def _files(self, folder: str) -> list[Shard]:
        fs, p = hadoop_path(self.spark, folder)
        return [Shard(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")] if fs.exists(p) else []

    def _swap(self, schema: str, gone: set[str], new: list[Shard], retries: int = 20) -> int:
        for _ in range(retries):
            now = self.manifest()
            held = [Shard(s["path"], s["size"]) for s in now["shards"]]
            if not gone <= {s.path for s in held}:
                raise CommitConflict("another compaction took some of these shards")
            try:
                return self.commit(now["version"], schema, [s for s in held if s.path not in gone] + new)
            except CommitConflict:
                continue
        raise CommitConflict(f"no commit in {retries} attempts")

    def append(self, df: DataFrame) -> int:
        """Adds the rows as small shards, a file for each of df's partitions that has rows; all columns, nulls included."""
        known = self.manifest()["schema"]
        if known is not None and json.loads(known) != json.loads(df.schema.json()):
            raise ValueError("the rows' schema isn't the store's")
        return self._swap(df.schema.json(), set(), self._write(df))

    def stage(self, df: DataFrame, arrival: Column, arrivals: int) -> list[list[Shard]]:
        """Writes the rows of all arrivals in one pass over df, each into shards of its own; nothing is committed yet."""
        name = free_name(df, "arrival")
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(run)
        return [self._files(f"{run}/{name}={i}") for i in range(arrivals)]

    def admit(self, schema: str, shards: list[Shard]) -> int:
        """Commits a version that adds staged shards."""
        known = self.manifest()["schema"]
        if known is not None and json.loads(known) != json.loads(schema):
            raise ValueError("the rows' schema isn't the store's")
        return self._swap(schema, set(), shards)

    def tier(self, size: int) -> int:
        tier = 0
        while size >= self.smallest_bytes * self.fan_in ** (tier + 1):
            tier += 1
        return tier

    def due(self) -> list[Shard]:
        """The shards of the lowest tier that has fan_in of them; none when all tiers are short or full-sized."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.size < self.target_bytes // 2:
                tiers.setdefault(self.tier(s.size), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self) -> int:
        """Merges until nothing is due. Files are read in runs and written without a shuffle."""
        while run := self.due():
            total = sum(s.size for s in run)
            files = max(1, round(total / self.target_bytes))
            self._swap(self.manifest()["schema"], {s.path for s in run}, self._write(self.read_shards(run).coalesce(files)))
        return self.version()

    def read_shards(self, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.manifest()["schema"]))
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """A whole version, with the hidden _metadata columns that file sources have."""
        return self.read_shards(self.shards(version))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes the shards that none of the last versions names; not while a reader holds an older one or rows are staged."""
        last = self.version()
        named = {s.path for v in range(max(1, last - keep_versions + 1), last + 1) for s in self.shards(v)}
        fs, p = hadoop_path(self.spark, f"{self.path}/data")
        gone = 0
        for run in fs.listStatus(p):
            inner = [f.getPath() for f in fs.listStatus(run.getPath()) if f.isDirectory()]
            files = [f.getPath() for d in (run.getPath(), *inner) for f in fs.listStatus(d) if f.getPath().getName().startswith("part-")]
            dead = [f for f in files if f.toString() not in named]
            if len(dead) == len(files):
                fs.delete(run.getPath(), True)
            else:
                for f in dead:
                    fs.delete(f, False)
            gone += len(dead)
        return gone


def ingest(documents: DataFrame, path: str, *, arrivals: int = 4, id_col: str = "doc_id", **options) -> ShardStore:
    """Builds a store from documents that come in `arrivals` appends, compacting after each, and vacuums it at the end.

    The table is read once and written as the shards of all arrivals. The arrival of a row is a hash of its id, so a hot
    source or a group of copies is in all of them; rows with a null id come with the first. All columns are kept as they
    are, repeated rows too. An empty table gives a store whose versions have no rows.
    """
    need(documents, id_col)
    store = ShardStore(documents.sparkSession, path, **options)
    for shards in store.stage(documents, F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(arrivals)), F.lit(0)), arrivals):
        store.admit(documents.schema.json(), shards)
        store.compact()
    store.vacuum()
    return store


def placement(store: ShardStore) -> DataFrame:
    """All rows of the latest version with shard (its file's name), shard_bytes and version.

    Where the rows have a column so called, it stays, and the new one has an underscore after its name.
    """
    version, rows = store.version(), store.read()
    new = {"shard": F.col("_metadata.file_name"), "shard_bytes": F.col("_metadata.file_size"), "version": F.lit(version)}
    return rows.withColumns({free_name(rows, c): x for c, x in new.items()})
