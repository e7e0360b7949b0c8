"""Quality by compression: zstandard dictionaries of good and of bad text.

A dictionary is built from lines of good texts and one from lines of bad texts. A text is cut into pieces that are
compressed with either; the normalised difference of both sizes says which dictionary fits better. A logistic
calibration, on labelled rows whose texts did not build the dictionaries, turns it into a probability, with how
far the whole text compresses by itself and its length as context.

The fit sees a bounded sample: ``ROWS`` documents of either label, and ``PIECES`` lines of either label of half of them for
the dictionaries (those of the lowest hashes; lines that several texts share are left out, since they tell
nothing); the other half calibrates. Scoring is a map over the rows.

Rows: NULL text is the empty text, which gets a score like any other. Rows with a NULL label, or a label
that is neither 0 nor 1, teach nothing. Repeated rows score alike. Without labels of both kinds, each score is the share of
good labels, or 0.5 without any. Only the id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_of, fresh, lean, saved, slices

#: bounds of the sample: documents of each label, lines of each label, bytes of a line
ROWS, PIECES, PIECE_BYTES = 6000, 12_000, 512
DICTIONARY_BYTES = 112_640
#: a text is predicted good from this score on
ACCEPT = 0.7
#: bytes that are compressed at a time
WINDOW = 2048


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the calibration; ``prior`` is the score where they are missing."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: their text itself
        return b"\n".join(pieces)[-size:]


@lru_cache(maxsize=4)
def _compressors(model: Model) -> tuple:
    plain = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    made = [zstandard.ZstdCompressor(**plain)]
    for content in (model.good, model.bad):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=3)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, **plain))
    return tuple(made)


def measures(text: str | None, model: Model) -> list[float]:
    """Inputs of the calibration: the normalised size difference and what it depends on."""
    plain, good, bad = _compressors(model)
    raw = (text or "").encode()
    if not raw:
        return [1.0, 0.0, 0.0, 0.9, 0.0, 0.0, 0.0, 0.0]
    pieces = [raw[at : at + WINDOW] for at in range(0, len(raw), WINDOW)]
    with_good = sum(len(good.compress(piece)) for piece in pieces)
    with_bad = sum(len(bad.compress(piece)) for piece in pieces)
    gain = (with_bad - with_good) / (with_bad + with_good)
    rest = len(plain.compress(raw)) / len(raw)
    size = np.log1p(len(raw)) / 10
    return [1.0, gain, max(0.0, 0.45 - rest) * 10, min(rest, 0.9), size, gain * size, gain * abs(gain), gain * min(rest, 1.2)]


def calibrate(inputs: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    weights = np.zeros(inputs.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        curve = inputs.T @ (inputs * (p * (1 - p))[:, None]) + ridge * np.eye(len(weights))
        weights += np.linalg.solve(curve, inputs.T @ (labels - p) - ridge * weights)
    return tuple(float(w) for w in weights)


def held_out(id_column: Column) -> Column:
    """Rows that no fit may learn labels from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """Texts with labels that a fit may learn from, saved: at most ``rows`` ids of either label, those of the least hashes.

    Ids are drawn from the narrow labels, so that texts are read once and not shuffled. An id labelled both ways
    teaches nothing.
    """
    own = (
        labels.where(~held_out(F.col(id_col)) & F.col("quality").isin(0, 1))
        .groupBy(id_col)
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("__most"))
        .where(F.col("quality") == F.col("__most"))
        .select(F.col(id_col).alias("__id"), "quality")
    )
    drawn = [
        own.where(F.col("quality") == label).orderBy(F.xxhash64("__id"), "__id").limit(rows) for label in (0, 1)
    ]
    texts = docs.select(F.col(id_col).alias("__id"), "text")
    # 2 x rows ids at most
    sample = texts.join(F.broadcast(drawn[0].unionAll(drawn[1])), "__id").select("text", "quality")
    return saved(sample, "labelled")


def _map(rows: DataFrame, keep: list[str], text_col: str, model: Model, outputs: list[T.StructField], run) -> DataFrame:
    schema = T.StructType([*[field_of(rows, c) for c in keep], *outputs])

    @lean
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(len(keep))
            for start, end in slices(batch, (len(t.as_py() or "") for t in texts)):
                made = run([measures(t.as_py(), model) for t in texts.slice(start, end - start)])
                kept = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, made], names=schema.names)

    return rows.select(*keep, F.col(text_col).alias(fresh("__text", keep))).mapInArrow(batches, schema)


def fit(
    labelled: DataFrame, label_col: str = "quality", text_col: str = "text", pieces: int = PIECES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> Model:
    """Dictionaries and calibration from a bounded sample; equal texts fall on the same side of the split."""
    known = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label")
    )
    known = known.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)))
    lines = known.where("fold = 0").select("label", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    alone = (
        lines.where("line <> ''")
        .groupBy(F.xxhash64("line").alias("key"))
        .agg(F.count("*").alias("n"), F.first("line").alias("line"), F.first("label").alias("label"))
        .where("n = 1")
    )
    cut = F.expr(
        f"transform(sequence(0, cast((octet_length(line) - 1) / {PIECE_BYTES} as int)), "
        f"i -> substring(cast(line as binary), i * {PIECE_BYTES} + 1, {PIECE_BYTES}))"
    )
    parts = saved(alone.select("label", F.explode(cut).alias("piece")), "pieces")
    drawn = {
        label: [
            bytes(r["piece"])
            for r in parts.where(F.col("label") == label).orderBy(F.xxhash64("piece"), "piece").limit(pieces).collect()
        ]
        for label in (1, 0)
    }
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    if not drawn[0] or not drawn[1]:
        return Model(b"", b"", (), prior)
    raw = Model(_dictionary(drawn[1], dictionary_bytes), _dictionary(drawn[0], dictionary_bytes), (), prior)
    output = T.StructField("inputs", T.ArrayType(T.DoubleType()))
    found = _map(known.where("fold = 1"), ["label"], "text", raw, [output], lambda m: pa.array(m, pa.list_(pa.float64()))).collect()
    if len({r["label"] for r in found}) < 2:
        return Model(b"", b"", (), prior)
    weights = calibrate(np.array([r["inputs"] for r in found]), np.array([float(r["label"]) for r in found]))
    return Model(raw.good, raw.bad, weights, prior)


def score(
    docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", output: str = "score"
) -> DataFrame:
    """The kept columns and the score: the probability that a text is good."""
    keep = ["doc_id"] if keep is None else keep
    if not model.weights:
        return docs.select(*keep, F.lit(float(model.prior)).alias(output))
    weights = np.array(model.weights)

    def run(inputs: list[list[float]]) -> pa.Array:
        margin = np.clip(np.array(inputs).reshape(-1, len(weights)) @ weights, -30, 30)
        return pa.array(1 / (1 + np.exp(-margin)), pa.float64())

    return _map(docs, keep, text_col, model, [T.StructField(output, T.DoubleType())], run)
