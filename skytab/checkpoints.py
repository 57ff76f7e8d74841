"""Lineage cuts: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_OPEN: ContextVar[list[str] | None] = ContextVar("skytab_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a temporary folder on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _FALLBACK.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="skytab-shared-"))


def cut(df: DataFrame, name: str, codec: str = "snappy", **options: object) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``options`` go to the Parquet writer.

    The table survives lost executors, is computed once however often it is read, and lets joins on
    it be planned from shuffles on both sides, so that AQE can split a hot key. Within ``scratch`` it
    is deleted at the end.
    """
    path = f"{shared_dir(df.sparkSession)}/skytab-{name}-{uuid.uuid4().hex}"
    if (held := _OPEN.get()) is not None:
        held.append(path)
    df.write.options(**options).option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(table: DataFrame) -> None:
    """Remove a table that ``cut`` wrote, once nothing reads it any more; of any other DataFrame nothing goes."""
    if path := getattr(table, "written_to", None):
        delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table from whatever file system it lies on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose cuts are deleted when it ends. It yields a function like ``cut`` for the result, which stays."""
    outer, own = _OPEN.get(), []
    token = _OPEN.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        if (path := getattr(df, "written_to", None)) in own:  # as it is
            own.remove(path)
            if outer is not None:
                outer.append(path)
            return df
        inner = _OPEN.set(outer)
        try:
            return cut(df, name)
        finally:
            _OPEN.reset(inner)

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in own:
            delete(spark, path)


def tidy(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For operators that write tables on the way: their result is written, under ``name``, and the others are deleted."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(first: DataFrame, *args: object, **kwargs: object) -> DataFrame:
            with scratch(first.sparkSession) as keep:
                return keep(operator(first, *args, **kwargs), name)

        return run

    return wrap
