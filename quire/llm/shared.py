"""Where intermediate tables and files go, how lineage is cut, and how rows meet functions of whole batches.

All that is written here lives under ``spark.checkpoint.dir``, the folder the cluster shares, so a lost executor
never takes an intermediate result with it. Where a session has none, a folder of our own is set for local masters only.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session: ``spark.checkpoint.dir``; a new one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_FOLDERS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _FOLDERS.append(f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}")
    return f"{_FOLDERS[-1]}/{name}"


def remove_intermediate(spark: SparkSession) -> None:
    """Deletes all that operators of this driver have put in the shared folder; no result may be read after it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _FOLDERS:
        path = hadoop.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of whole texts, and bytes, that jobs started here hand to Python at a time.
TEXT_ROWS, BATCH_BYTES = 1024, 16 << 20


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """While it holds, jobs hand at most so many rows at a time to Python; the session's own setting comes back."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    for n, most in zip(names, (rows, BATCH_BYTES), strict=True):
        if most:
            own = int(before[n].rstrip("bB"))
            spark.conf.set(n, str(min(most, own) if own > 0 else most))
    try:
        yield
    finally:
        for n, x in before.items():
            spark.conf.set(n, x)


def written(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """The rows of df as a table written to the shared folder, read back: the plan above it starts anew."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches_of(spark, rows or TEXT_ROWS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


# arrays in files


def _local(uri: str) -> str | None:
    """The path of a mounted file or folder, None for one of another store."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Saving:
    """Arrays written piece by piece as the files ``name.key`` of a folder in the shared store.

    Names are new for every attempt of a task, and only what a finished task reports is read, so nothing is renamed.
    """

    def __init__(self, folder: str, prefix: str):
        self.folder, self.name, self.files = folder, f"{prefix}-{uuid.uuid4().hex}", {}

    def add(self, **arrays: np.ndarray) -> None:
        for key, x in arrays.items():
            if key not in self.files:
                self.files[key] = self._open(key)
            self.files[key].write(x.tobytes())

    def _open(self, key: str):
        if (local := _local(self.folder)) is not None:
            os.makedirs(local, exist_ok=True)
            return open(f"{local}/{self.name}.{key}", "wb")  # noqa: SIM115
        store, path = _store(self.folder)
        store.create_dir(path)
        return store.open_output_stream(f"{path}/{self.name}.{key}")

    def close(self) -> str | None:
        """The name, if anything was added."""
        for f in self.files.values():
            f.close()
        return self.name if self.files else None


class Stored:
    """Arrays of a folder in the shared store, memory-mapped by workers.

    Files of a mounted folder are mapped in place. Those of another store are fetched once to the executor's scratch
    folder, checked by size, and fetched again where they are gone.
    """

    _maps: dict[str, np.ndarray] = {}

    def __init__(self, folder: str):
        self.folder = folder

    def array(self, name: str, kind, width: int = 0) -> np.ndarray:
        key = f"{self.folder}/{name}"
        if key not in self._maps:
            path = self._path(key)
            size = os.path.getsize(path)  # a file that is gone is an error, not an empty array
            self._maps[key] = np.memmap(path, kind, "r") if size else np.empty(0, kind)
        out = self._maps[key]
        return out.reshape(-1, width) if width else out

    @staticmethod
    def _path(uri: str) -> str:
        if (local := _local(uri)) is not None:
            return local
        store, path = _store(uri)
        size = store.get_file_info(path).size
        scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()
        own = f"{scratch}/quire-cache/{path.strip('/').replace('/', '~')}"
        if not os.path.exists(own) or os.path.getsize(own) != size:
            os.makedirs(os.path.dirname(own), exist_ok=True)
            with store.open_input_stream(path) as source, open(part := f"{own}.{uuid.uuid4().hex}", "wb") as f:
                while block := source.read(8 << 20):
                    f.write(block)
            os.replace(part, own)
        return own


# rows and batches


def release() -> None:
    """Gives freed memory back: workers live on after their task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if not _LIBC:
        with contextlib.suppress(OSError):
            _LIBC.append(ctypes.CDLL("libc.so.6"))
    with contextlib.suppress(AttributeError, IndexError):
        _LIBC[0].malloc_trim(0)


_LIBC: list = []


def released(run: Callable) -> Callable:
    """A mapper of batches that ends by giving memory back."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def free_name(name: str, taken) -> str:
    """name, with "_in" behind it as often as it takes to be none of the taken ones."""
    while name in taken:
        name += "_in"
    return name


def arrow_rows(docs: DataFrame, made: Callable[[pa.Array], list[pa.Array]], schema: str, id_col: str, text: str) -> DataFrame:
    """(id_col, the columns of schema): what made gives for a batch of texts, one row for each. Other columns are not read."""
    from pyspark.sql.types import StructField, StructType

    own = StructType.fromDDL(schema)
    name = free_name(id_col, own.names)
    out = StructType([StructField(name, docs.schema[id_col].dataType), *own])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *made(batch.column(1))], names=out.names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(released(run), out)


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text: str) -> DataFrame:
    """docs, all columns, where keep is true of the text. Only the texts go to Python, and only a mark comes back."""
    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        try:
            return pa.array(keep(texts), pa.bool_())
        finally:
            release()

    return docs.where(kept(F.col(text)))
