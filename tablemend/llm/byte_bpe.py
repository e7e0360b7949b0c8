"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut where the splitting pattern must end a match anyway: between a character that is no white
space and white space. No alternative of the pattern has white space after another character, and what
follows such a place is matched alike whatever stands before it, so the pieces give the ids of the whole.

Rows: NULL or empty text has no ids and decodes to no bytes. Rows are independent, so repeated ids and
repeated rows are kept as they are. Only the id and text columns are read; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, field_of, lean, slices

#: texts beyond this many characters are encoded in pieces
PIECE = 1 << 16

_SAFE = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of one rank file; read once per worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Pieces of about ``piece`` characters; longer only where no safe boundary comes before."""
    start = 0
    while len(text) - start > piece:
        cut = _SAFE.search(text, start + piece)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def text_ids(text: str | None, codec: tiktoken.Encoding, piece: int = PIECE) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= piece:
        return np.array(codec.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(codec.encode_ordinary(part), "<u4") for part in safe_pieces(text, piece)])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit integers)."""
    schema = T.StructType(
        [field_of(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for start, end in slices(batch, (4 * (len(t.as_py() or "") // 2) for t in texts)):
                ids = [text_ids(t.as_py(), codec) for t in texts.slice(start, end - start)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=[id_col, "n_tokens", "ids"],
                )

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the raw bytes of packed ids; bytes need not be whole characters."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index(ids_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(ranks_path, pattern)
        for batch in batches:
            packed = batch.column(at)
            for start, end in slices(batch, (2 * len(p.as_buffer() or b"") for p in packed)):
                part = batch.slice(start, end - start)
                decoded = [
                    codec.decode_bytes(np.frombuffer(p.as_buffer(), "<u4").tolist()) if p.is_valid else b""
                    for p in part.column(at)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"]
                )

    return encoded.mapInArrow(run, schema)
