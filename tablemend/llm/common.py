"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.session import work_folder

#: the white space that separates words everywhere in this subpackage
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

#: Unicode white space as the splitting pattern's engine has it
BLANK = "".join(
    map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

#: rows and bytes that one yielded Arrow batch holds at most (one row may be larger)
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text, in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that is not taken yet, in any case of letters."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, for the tables of one run."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """A frame written to a new shared folder and read from there: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back memory that a worker has freed: reused workers would hold their peaks through every later stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: what workers keep between tasks, by the module that keeps it
_kept: dict[str, list[dict]] = {}


def keeps(module: str, *caches: dict) -> None:
    """Say which caches a module keeps between tasks of a worker."""
    _kept.setdefault(module, []).extend(caches)


def forget_others(module: str) -> None:
    """Empty the caches of other modules: a worker that has moved on to another operator needs them no more."""
    for owner, caches in _kept.items():
        if owner != module:
            for cache in caches:
                cache.clear()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of Arrow batches that finds and leaves its worker as small as it can."""
    module = run.__module__

    @functools.wraps(run)
    def kept_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(module)
        try:
            yield from run(batches)
        finally:
            release()

    return kept_small


def field_of(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or column, df.schema[column].dataType, True)


def slices(batch: pa.RecordBatch, sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that keep to BATCH_ROWS and BATCH_BYTES."""
    start = held = 0
    at = -1
    for at, size in enumerate(sizes):
        if at > start and (at - start >= BATCH_ROWS or held + size > BATCH_BYTES):
            yield start, at
            start, held = at, 0
        held += size
    if at >= start:
        yield start, at + 1
