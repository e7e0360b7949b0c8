"""Removal of long repeats by recompression.

Words are symbols. Each round renames the text: first maximal runs of one word, then, in every further round,
pairs of a left and a right symbol, where a symbol's hash says which it is. A name is a hash of what it stands for, so
it is the same in all documents, and whether two neighbours form a pair depends on these two alone. Equal passages
therefore get equal names but for a few symbols at their ends, which the parse knows: of each window of words it
follows the range of symbols that any copy of the window must show as well.

A repeated window shows only names that occur twice or more anywhere. Spark counts the names of the last round
(those of ``NAME_WORDS`` words or more), and windows with a name that is alone are dropped. The few windows that are left
are verified: Spark counts their 128-bit hashes of all words. Nothing else is sampled or bounded: every window of every
text is judged.

Documents travel in blocks of a few MB; names and windows are folded to one row per block before they
are dealt out by name, so a passage that a third of all documents share gives one row per block. Blocks are joined
back by their number.

Rows: NULL text has no words. Texts shorter than a window keep all words. Repeated rows and equal texts repeat each
other: all their windows are removed. NULL or repeated ids give a row each. An empty table gives no rows. Only the id
and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import OTHER, PRIME, U64, mix, powers, to_blocks, unpacked, word_hashes
from .common import field_of, lean, saved

WINDOW = 35
#: rounds of pairs; further rounds leave windows of 35 words without a whole name
ROUNDS = 5
#: names of fewer words are too common to tell windows apart
NAME_WORDS = 4

@dataclass
class Parse:
    """Words of a block, its names after the last round, and the names that each window must share with its copies."""

    words: np.ndarray
    counts: np.ndarray  # words of each text
    starts: np.ndarray  # first words of windows within one text
    names: np.ndarray
    sizes: np.ndarray  # words of a name
    low: np.ndarray  # per window: first and last (exclusive) name that any copy shows
    high: np.ndarray


def parse(texts: list[str | None], window: int = WINDOW, rounds: int = ROUNDS) -> Parse:
    """Rename the words of some texts round by round."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, places = word_hashes(b"\n".join(raw))
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, places, side="right")
    counts = np.bincount(doc, minlength=len(raw)) if len(words) else np.zeros(len(raw), np.int64)
    n = len(words)
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else np.empty(0, np.int64)
    names, sizes, of = words, np.ones(n, np.int64), doc
    low, high = starts.copy(), starts + window
    for turn in range(rounds + 1):
        if not len(names):
            break
        size = len(names)
        if turn == 0:  # runs; a run at the edge of a window may go on outside
            fresh = np.ones(size, bool)
            fresh[1:] = (names[1:] != names[:-1]) | (of[1:] != of[:-1])
            heads = np.flatnonzero(fresh)
            length = np.diff(np.append(heads, size))
            place = np.append(np.cumsum(fresh) - 1, len(heads))
            renamed = np.where(length > 1, mix(names[heads] * OTHER + length.astype(np.uint64)), names[heads])
            low, high = place[low] + 1, place[high - 1]
        else:  # pairs; a right symbol at the start, or a left one at the end, may pair with one outside
            right = (mix(names ^ U64(turn * 0x12345677)) & U64(1)).astype(bool)
            pair = np.zeros(size, bool)
            pair[:-1] = ~right[:-1] & right[1:] & (of[:-1] == of[1:])
            fresh = np.ones(size, bool)
            fresh[1:] = ~pair[:-1]
            heads = np.flatnonzero(fresh)
            place = np.append(np.cumsum(fresh) - 1, len(heads))
            following = names[np.minimum(heads + 1, size - 1)]
            renamed = np.where(pair[heads], mix(names[heads] * PRIME + mix(following) + U64(turn)), names[heads])
            padded = np.append(right, False)
            first = np.minimum(low, size)
            low = place[np.minimum(first + padded[first], size)]
            last = np.clip(high - 1, 0, size - 1)
            high = place[np.maximum(np.where(right[last], high, high - 1), 0)]
        sizes = np.add.reduceat(sizes, heads)
        names, of = renamed, of[heads]
    return Parse(words, counts, starts, names, sizes, low, high)


def _told(parsed: Parse) -> np.ndarray:
    return parsed.sizes >= NAME_WORDS


def candidates(parsed: Parse, shared: np.ndarray) -> np.ndarray:
    """First words of windows all of whose names occur twice or more."""
    own, times = np.unique(parsed.names[_told(parsed)], return_counts=True)
    alone = _told(parsed) & ~np.isin(parsed.names, np.concatenate([shared, own[times > 1]]))
    before = np.append(0, np.cumsum(alone))
    return parsed.starts[before[np.maximum(parsed.high, parsed.low)] == before[parsed.low]]


def window_hashes(parsed: Parse, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of all words of windows."""
    pair = []
    for base in (PRIME, OTHER):
        total = np.zeros(len(starts), np.uint64)
        for at, power in enumerate(powers(base, window)):
            total += parsed.words[starts + at] * power
        pair.append(mix(total))
    return pair[0], pair[1]


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    heads = np.flatnonzero(fresh)
    return first[heads], second[heads], np.diff(np.append(heads, len(first)))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _set(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).view(np.uint64) if value.is_valid else np.empty(0, np.uint64)


def block_names(blocks: DataFrame) -> DataFrame:
    """Distinct names of each block, and whether it holds them twice or more."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0), batch.column(1), strict=True):
                parsed = parse(unpacked(rows.as_py()).column(1).to_pylist())
                names, times = np.unique(parsed.names[_told(parsed)], return_counts=True)
                for at in range(0, len(names), 1 << 16):
                    part, many = names[at : at + (1 << 16)], times[at : at + (1 << 16)] > 1
                    yield pa.RecordBatch.from_arrays(
                        [_longs(part), pa.array(np.full(len(part), number.as_py())), pa.array(many)],
                        names=["name", "block", "many"],
                    )

    return blocks.select("block", "rows").mapInArrow(run, "name bigint, block bigint, many boolean")


def block_windows(known: DataFrame) -> DataFrame:
    """Distinct hashes of the candidate windows of each block, and whether it holds them twice or more."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows, shared in zip(*batch.columns[:3], strict=True):
                parsed = parse(unpacked(rows.as_py()).column(1).to_pylist())
                found = window_hashes(parsed, candidates(parsed, _set(shared)))
                first, second, times = _distinct(*found)
                for at in range(0, len(first), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [
                            _longs(first[cut]),
                            _longs(second[cut]),
                            pa.array(np.full(len(first[cut]), number.as_py())),
                            pa.array(times[cut] > 1),
                        ],
                        names=["first", "second", "block", "many"],
                    )

    columns = "first bigint, second bigint, block bigint, many boolean"
    return known.select("block", "rows", "shared").mapInArrow(run, columns)


def _per_block(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.groupBy("block").agg(F.collect_list(value).alias(name))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = (), as_is: bool = False,
    names: tuple[str, str, str] = ("n_words", "n_removed", "kept"),
) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space) and other columns.

    ``names`` are those of the three results. With ``as_is`` a text that loses no word keeps its own white space, and NULL stays NULL.
    """
    blocks = to_blocks(docs, id_col, text_col, others)
    named = Window.partitionBy("name")
    shared = block_names(blocks).withColumn("n", F.count("*").over(named)).where((F.col("n") > 1) & ~F.col("many"))
    shared = saved(_per_block(shared, "name", "shared"), "shared")
    known = blocks.join(shared, "block", "left")
    hashed = Window.partitionBy("first", "second")
    single = block_windows(known).withColumn("n", F.count("*").over(hashed)).where((F.col("n") == 1) & ~F.col("many"))
    judged = known.join(_per_block(single, "first", "single"), "block", "left")
    schema = T.StructType(
        [
            field_of(docs, id_col),
            T.StructField(names[0], T.LongType()),
            T.StructField(names[1], T.LongType()),
            T.StructField(names[2], T.StringType()),
            *[field_of(docs, c) for c in others],
        ]
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found, once in zip(*batch.columns[:3], strict=True):
                yield from _judged(unpacked(rows.as_py()).combine_chunks(), _set(found), _set(once), schema.names, as_is)

    return judged.select("rows", "shared", "single").mapInArrow(run, schema)


def _judged(table: pa.Table, shared: np.ndarray, once: np.ndarray, names: list[str], as_is: bool) -> Iterator[pa.RecordBatch]:
    texts = table.column(1).to_pylist()
    parsed = parse(texts)
    starts = candidates(parsed, shared)
    first, _ = window_hashes(parsed, starts)
    repeated = starts[~np.isin(first, once)]
    change = np.zeros(len(parsed.words) + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + WINDOW, -1)
    removed = np.cumsum(change[:-1]) > 0
    ends = np.cumsum(parsed.counts)
    at = 0
    for part in table.to_batches(max_chunksize=512):
        kept, lost, counts = [], [], parsed.counts[at : at + part.num_rows]
        for row in range(at, at + part.num_rows):
            gone = removed[ends[row] - parsed.counts[row] : ends[row]]
            lost.append(int(gone.sum()))
            if as_is and not lost[-1]:
                kept.append(texts[row])
                continue
            words = (texts[row] or "").encode("utf-8", "surrogatepass").split()
            if lost[-1]:
                words = [words[i] for i in np.flatnonzero(~gone)]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        at += part.num_rows
        columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=names)
