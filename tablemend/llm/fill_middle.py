"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together anew behind marks.

Cuts are made on UTF-8 bytes. A sparse exception index of a text holds only its multibyte characters: their code-point
positions and the excess bytes up to them. ``searchsorted`` finds how many exceptions lie before a cut, and their excess
turns a code-point cut into a byte cut or back; between exceptions, and in ASCII text, the two differ by a constant.

A text is cut between units: lines (with their line feed) or code points. Draws come from a hash of the document's id
and the seed, so they are the same on every run and on every machine.

Rows: NULL text counts as empty. Empty texts, and texts that hold one of the marks, stay plain. A NULL id draws like
an empty one. Rows are independent, so repeated ids and repeated rows are kept as they are, and no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_of, lean, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Exceptions:
    """Multibyte characters of a text: code-point position of each, and excess bytes before it (one more: of the whole text)."""

    chars: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Exceptions:
        """Index of UTF-8 bytes: leading bytes say how wide their characters are."""
        leads = np.flatnonzero(raw >= 0xC0)
        widths = raw[leads]
        excess = np.zeros(len(leads) + 1, np.int64)
        np.cumsum(1 + (widths >= 0xE0) + (widths >= 0xF0), out=excess[1:])
        return cls(leads - excess[:-1], excess)

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Byte cuts of code-point cuts."""
        return cuts + self.excess[np.searchsorted(self.chars, cuts)]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code-point cuts of byte cuts, which lie between characters."""
        return cuts - self.excess[np.searchsorted(self.chars + self.excess[:-1], cuts)]


def cut(raw: np.ndarray, first: int, second: int, unit: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of units, and the two cuts that the draws ask for, in bytes and in code points."""
    index = Exceptions.of(raw)
    if unit == "char":
        n = len(raw) - int(index.excess[-1])
    else:
        feeds = np.flatnonzero(raw == 10)
        n = len(feeds) + int(len(raw) > 0 and raw[-1] != 10)
    units = np.sort(np.array([first % (n + 1), second % (n + 1)], np.int64))
    if unit == "char":
        return n, index.to_bytes(units), units
    ends = np.concatenate([[0], feeds + 1, [len(raw)]])
    return n, ends[units], index.to_chars(ends[units])


def put_together(text: bytes, cuts: np.ndarray, spm: bool) -> bytes:
    a, b = (int(c) for c in cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    parts = [SUFFIX, suffix, PREFIX, prefix] if spm else [PREFIX, prefix, SUFFIX, suffix]
    return b"".join([*parts, MIDDLE, middle])


def take_apart(output: bytes, form: str) -> bytes:
    """The text of an output. No mark lies in a text, and none can arise across a cut, since marks do not overlap."""
    if form == PLAIN:
        return output
    second = output.index(PREFIX if form == SPM else SUFFIX)
    third = output.index(MIDDLE, second)
    one, two, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    prefix, suffix = (two, one) if form == SPM else (one, two)
    return prefix + middle + suffix


def draws(id_column: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned 32-bit draws of a row: groups of eight digits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(n)]


def transform(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` percent of the texts are cut, ``spm`` percent of these give their suffix first; ``unit`` is line or char.
    The two lengths are NULL where the form is plain.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unknown unit: {unit}")
    schema = T.StructType(
        [
            field_of(docs, id_col),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )

    def one(text: bytes, first: int, second: int, third: int, fourth: int) -> tuple:
        n, at, chars = cut(np.frombuffer(text, np.uint8), first, second, unit)
        if not text or third % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            return n, PLAIN, None, None, text
        last = fourth % 100 < spm
        return n, SPM if last else PSM, int(chars[0]), int(chars[1] - chars[0]), put_together(text, at, last)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for start, end in slices(batch, lengths):
                part = batch.slice(start, end - start)
                texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1))
                rows = [one(t, *h) for t, h in zip(texts, zip(*(c.to_pylist() for c in part.columns[2:])))]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, F.col(text_col).alias("__text"), *draws(F.col(id_col), seed)).mapInArrow(run, schema)


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds ``restored``: the text of each output, rebuilt from output and form alone."""
    schema = T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())])
    output, form = made.columns.index(output_col), made.columns.index(form_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(output)).fill_null(0).to_pylist()
            for start, end in slices(batch, lengths):
                part = batch.slice(start, end - start)
                texts = [
                    take_apart(o.as_buffer().to_pybytes(), f) if o.is_valid else b""
                    for o, f in zip(part.column(output), part.column(form).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names
                )

    return made.mapInArrow(run, schema)
