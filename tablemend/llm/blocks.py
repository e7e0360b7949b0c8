"""Documents in numbered, compressed blocks, and hashes of their words.

Operators that read their texts more than once write them as blocks to the shared folder, so that every pass reads the
same rows under the same numbers; a block is joined back by its number, and a row is known by block and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, saved, slices

#: text bytes and rows of a block, unless one document is larger; blocks of one task
BLOCK_BYTES, BLOCK_ROWS, BLOCKS = 2 << 20, 1 << 16, 1 << 20
#: bytes of text that are hashed at a time
_CHUNK = 1 << 18

U64 = np.uint64
PRIME, OTHER = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a text in UTF-8."""
    hashes, starts = [], []
    at = 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            sizes = last - first
            within = np.zeros(len(raw), np.int64)
            within[first[0] :] = np.arange(first[0], len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
            power = powers(PRIME, int(sizes.max()) + 1)
            parts = np.where(inside, _BYTES[raw] * power[np.minimum(within, len(power) - 1)], U64(0))
            hashes.append(mix(np.add.reduceat(parts, first) + sizes.astype(np.uint64) * OTHER))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def to_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Documents in numbered, compressed blocks, written to the shared folder so that every pass reads the same ones.

    Blocks hold the id first, then the text, then the other columns.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * BLOCKS
        press = zstandard.ZstdCompressor(level=3)
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for part in held:
                    stream.write_batch(part)
            packed = press.compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed], pa.binary())], names=["block", "rows"])

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for start, end in slices(batch, lengths):
                more = sum(lengths[start:end])
                if held and (size + more > BLOCK_BYTES or rows + end - start > BLOCK_ROWS):
                    yield block()
                    number, size, rows, held = number + 1, 0, 0, []
                held.append(batch.slice(start, end - start))
                size += more
                rows += end - start
        if held:
            yield block()

    return saved(docs.select(id_col, text_col, *others).mapInArrow(run, "block bigint, rows binary"), "blocks")


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_all()
