"""Session helpers: tables, the shared folder, the train/held-out split."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session on one machine that names none (tests) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textsentry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def local_path(uri: str) -> str | None:
    """The path that ``open`` understands, or None for a store that only Spark reads."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


#: Where scopes opened in this thread are listed, inside of :func:`opened`.
_listed: ContextVar[list[Scope] | None] = ContextVar("scopes", default=None)


class Scope:
    """The tables that one call writes to the shared folder; calls do not see each other's."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()
        if (listed := _listed.get()) is not None:
            listed.append(self)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, survives lost executors."""
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.paths.add(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def drop(self, *frames: DataFrame | str | None) -> None:
        """Delete tables of this scope, as :meth:`written` returned them or by path, that nothing reads any more."""
        for frame in frames:
            path = frame if isinstance(frame, str) else getattr(frame, "_path", None)
            if path in self.paths:
                self.paths.discard(path)
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def owned(self, df: DataFrame, *behind: DataFrame) -> DataFrame:
        """``df``, the result of the call, once all tables but those ``behind`` it are deleted."""
        stay = {getattr(f, "_path", None) for f in behind}
        self.drop(*(self.paths - stay))
        df._scope = self
        return df

    def close(self) -> None:
        self.drop(*self.paths)


def discard(df: DataFrame) -> None:
    """Delete the tables behind the result of an operator, once it has been read for the last time."""
    if scope := getattr(df, "_scope", None):
        scope.close()


@contextmanager
def opened() -> Iterator[list[Scope]]:
    """The scopes that this thread opens inside of the block; whoever needs their tables no more closes them."""
    token = _listed.set([])
    try:
        yield _listed.get()
    finally:
        _listed.reset(token)


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def unit_hash(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Run) -> Run:
    """``run``, after which the worker gives freed memory back: idle workers stay alive between tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
