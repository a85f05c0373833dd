"""Model files on the driver: where they are kept, whether they are there, and fetching them once.

Everything here runs before a job starts. Executors get files by SparkContext.addFile or from shared storage.
"""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

VARIABLE = "VERBALOOM_CACHE"
ATTEMPTS = 4


def cache_dir(given: str | Path | None = None) -> Path:
    """The argument, else the environment's VERBALOOM_CACHE, else ~/.cache/verbaloom."""
    return Path(given or os.environ.get(VARIABLE) or Path.home() / ".cache" / "verbaloom").expanduser()


def resolve(name: str, cache: str | Path | None = None) -> Path:
    """A local folder or file by its path, or by its name in the cache; FileNotFoundError says where it was looked for."""
    for p in (Path(name).expanduser(), cache_dir(cache) / name):
        if p.exists():
            return p
    raise FileNotFoundError(f"{name} is neither a path nor in {cache_dir(cache)}")


def present_files(spark: SparkSession, cache: str | Path | None = None) -> DataFrame:
    """(model, file, bytes) of what the cache holds, to be held against a catalogue's files."""
    root = cache_dir(cache)
    rows = [(p.relative_to(root).parts[0], "/".join(p.relative_to(root).parts[1:]), p.stat().st_size) for p in root.rglob("*") if p.is_file() and len(p.relative_to(root).parts) > 1] if root.is_dir() else []
    return spark.createDataFrame(rows, "model string, file string, bytes long")


def fetch(url: str, target: str | Path, sha256: str | None = None, *, force: bool = False, wait: float = 1.0) -> Path:
    """Downloads to target unless it is there. A broken download goes on where it ended; the file appears whole or not at all."""
    target = Path(target)
    if target.exists() and not force:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    for attempt in range(ATTEMPTS):
        try:
            at = part.stat().st_size if part.exists() else 0
            request = urllib.request.Request(url, headers={"Range": f"bytes={at}-"} if at else {})  # noqa: S310
            with urllib.request.urlopen(request, timeout=60) as r, part.open("ab" if at and getattr(r, "status", None) == 206 else "wb") as f:  # noqa: S310
                while block := r.read(1 << 20):
                    f.write(block)
            break
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(wait * 2**attempt)
    if sha256 is not None:
        digest = hashlib.sha256()
        with part.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        if digest.hexdigest() != sha256.lower():
            part.unlink()
            raise ValueError(f"{url} has another checksum than {sha256}")
    os.replace(part, target)
    return target
