"""SentencePiece encoding by vectorised merge rounds, and decoding.

The model's own normaliser prepares a text. The symbols of many words lie in one flat numpy array; each round finds the
best pair of every word (segmented minimum of pair ranks), merges its occurrences from the left at once, closes the gaps
and looks up only the pairs that changed; a word leaves when no pair remains. The library merges one pair at a time, best
score first and leftmost among equals. A round does the same for many: of the occurrences chosen in a word, those after
the first whose merge makes a pair of equal or better rank wait for the next round, since that pair comes before them.

Words are cut where two characters stand together in no piece of the vocabulary: no merge can reach across such a place,
so the words of a text give the ids of the whole. Equal words of a group are merged once. Words beyond ``LONG`` symbols
(runs without any safe place, such as a megabyte of base64) are merged in the same order from a heap, since one round per
rank would be quadratic there. Long texts are taken in groups of about ``GROUP`` characters cut at safe places.

Rows: NULL or empty text has no ids and decodes to empty text. Rows are independent, so repeated ids and repeated rows are
kept as they are. Only the id and text columns are read. Models that are not BPE with byte fallback, or that have
user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from .blocks import PRIME, mix, powers
from .common import field_of, lean, slices

#: characters that are merged together; symbols from which a word is merged from a heap
GROUP, LONG = 1 << 19, 256
#: no pair
NONE = np.int32(np.iinfo(np.int32).max)
#: code points, and room for one more than any
_POINTS = 0x110000


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts`` and have ``sizes``, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Vocabulary:
    """Tables of one model: symbols of characters, ranks of pairs, and which characters ever stand together."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {piece.type for piece in model.pieces}
        kind = proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("not a BPE model with byte fallback")
        if kinds & {kind.USER_DEFINED, kind.UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        scores = np.array([p.score for p in model.pieces], np.float32)
        ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        #: ids of the pieces that stand for single bytes
        self.bytes = np.full(256, -1, np.int32)
        for i, piece in enumerate(model.pieces):
            if piece.type == kind.BYTE:
                self.bytes[int(piece.piece[3:-1], 16)] = i
        #: symbols are piece ids, then numbers of characters that occur in pieces only; others are below zero
        self.size = len(model.pieces)
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, self.size + len(symbols) - len(pieces))
        self.symbol = -1 - np.arange(_POINTS, dtype=np.int32)
        for text, s in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = s
        self.point = {s: ord(text) for text, s in symbols.items() if s >= self.size}
        found = {}
        for text, i in pieces.items():
            for k in range(1, len(text)):
                left, right = symbols.get(text[:k]), symbols.get(text[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = i
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.ranks = ranks[self.made]
        self.slots = self._slots()
        #: characters of longer pieces by small numbers, and the pairs of them that some piece holds
        joined = sorted({pair for p in pieces for pair in zip(p, p[1:])})
        number = {c: i for i, c in enumerate(sorted({c for pair in joined for c in pair}), 1)}
        self.small = np.zeros(_POINTS, np.int32)
        for c, i in number.items():
            self.small[ord(c)] = i
        self.width = len(number) + 1
        self.beside = np.zeros(self.width * self.width, bool)
        self.beside[[number[a] * self.width + number[b] for a, b in joined]] = True

    def joins(self, points: np.ndarray) -> np.ndarray:
        """Whether a piece may reach across, for each place between two characters."""
        small = self.small[points]
        return self.beside[small[:-1] * self.width + small[1:]]

    def _slots(self) -> np.ndarray:
        """Open hash table of the pairs: where each lies among ``keys``, or -1."""
        self.shift = np.uint64(62 - max(len(self.keys), 1).bit_length())
        slots = np.full(1 << int(np.uint64(64) - self.shift), -1, np.int32)
        left = np.arange(len(self.keys))
        at = self._home(self.keys)
        while len(left):
            slot, first = np.unique(at, return_index=True)
            free = slots[slot] < 0
            slots[slot[free]] = left[first[free]]
            stays = slots[at] != left
            left, at = left[stays], (at[stays] + 1) % len(slots)
        return slots

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * PRIME) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each pair; rank NONE where the pair is no piece."""
        rank, made = np.full(len(left), NONE), np.zeros(len(left), np.int32)
        asked = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[asked].astype(np.int64) << 32 | right[asked]
        at = self._home(key)
        while len(asked):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == key) if len(self.keys) else slot >= 0
            rank[asked[hit]], made[asked[hit]] = self.ranks[slot[hit]], self.made[slot[hit]]
            open_ = (slot >= 0) & ~hit
            asked, key, at = asked[open_], key[open_], (at[open_] + 1) % len(self.slots)
        return rank, made


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The tables of one model file; read once per worker."""
    return Vocabulary(path)


def merged_by_heap(symbols: np.ndarray, v: Vocabulary) -> np.ndarray:
    """One long word merged pair by pair."""
    sym = symbols.tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank, made = (x.tolist() for x in v.look_up(symbols[:-1], symbols[1:]))
    heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank, made)) if r != NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(i: int, j: int) -> None:
        pair = sym[i], sym[j]
        if pair not in known:
            r, m = v.look_up(np.array([pair[0]]), np.array([pair[1]]))
            known[pair] = int(r[0]), int(m[0])
        r, m = known[pair]
        if r != NONE:
            heapq.heappush(heap, (r, i, *pair, m))

    gone = -_POINTS - 1
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = m, gone
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return np.array([s for s in sym if s != gone], np.int32)


def merged(symbols: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Words (runs of ``sizes`` symbols, none empty) with all their merges done: flat symbols and new sizes."""
    done_symbols, done_words = [], []
    sym, word = symbols.copy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs that begin at the given places, NONE across words."""
        last = at + 1 >= len(sym)
        right = np.where(last, at, at + 1)
        rank, made = v.look_up(sym[at], sym[right])
        rank[last | (word[at] != word[right])] = NONE
        return rank, made

    rank, made = ranked(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        lengths = np.diff(np.append(starts, len(sym)))
        best = np.minimum.reduceat(rank, starts)
        over = np.repeat(best == NONE, lengths)
        if over.any():  # finished words leave
            done_symbols.append(sym[over])
            done_words.append(word[over])
            sym, word, rank, made = sym[~over], word[~over], rank[~over], made[~over]
            lengths, best = lengths[best != NONE], best[best != NONE]
            if not len(sym):
                break
        level = np.repeat(best, lengths)
        at = np.flatnonzero(rank == level)
        # of overlapping occurrences every other one, from the left
        fresh = np.diff(at, prepend=-2) > 1
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        # where a word has several, those up to the first that makes a pair of equal or better rank
        new = made[at]
        first = np.diff(word[at], prepend=-1) != 0
        several = np.flatnonzero(~(first & np.append(first[1:], True)))
        if len(several):
            here, new_here, first_here = at[several], new[several], first[several]
            touching = ~first_here & np.append(False, here[1:] == here[:-1] + 2)
            back = np.maximum(here - 1, 0)
            to_left, _ = v.look_up(np.where(touching, np.append(new_here[:1], new_here[:-1]), sym[back]), new_here)
            to_left[(here == 0) | (word[back] != word[here])] = NONE
            on = np.minimum(here + 2, len(sym) - 1)
            to_right, _ = v.look_up(new_here, sym[on])
            to_right[(here + 2 >= len(sym)) | (word[on] != word[here])] = NONE
            bad = np.minimum(to_left, to_right) <= level[here]
            before = np.cumsum(bad) - bad
            late = before != before[np.flatnonzero(first_here)[np.cumsum(first_here) - 1]]
            keep = np.ones(len(at), bool)
            keep[several[late]] = False
            at, new = at[keep], new[keep]
        # the right symbols go
        sym[at] = new
        stays = np.ones(len(sym), bool)
        stays[at + 1] = False
        now = at - np.arange(len(at))
        sym, word, rank, made = sym[stays], word[stays], rank[stays], made[stays]
        touched = np.zeros(len(sym), bool)
        touched[now] = touched[np.maximum(now - 1, 0)] = True
        changed = np.flatnonzero(touched)
        rank[changed], made[changed] = ranked(changed)
    if not done_symbols:
        return symbols, sizes
    sym, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(sizes))


def distinct(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each different word, and for every word the number of its like."""
    power = powers(PRIME, int(sizes.max()))
    within = ragged(np.zeros(len(sizes), np.int64), sizes)
    hashes = mix(np.add.reduceat(mix(points.astype(np.uint64) + np.uint64(1)) * power[within], starts) + sizes.astype(np.uint64))
    _, first, like = np.unique(hashes, return_index=True, return_inverse=True)
    # a hash decides nothing alone: words that differ from the first of their hash stand for themselves
    same = sizes[first[like]] == sizes
    compared = points[np.minimum(np.repeat(starts[first[like]], sizes) + within, len(points) - 1)] == points
    same &= np.logical_and.reduceat(compared, starts)
    own = np.flatnonzero(~same)
    like[own] = len(first) + np.arange(len(own))
    return np.concatenate([first, own]), like


def ids_of(symbols: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of merged words: a symbol that is no piece becomes the pieces of its bytes."""
    odd = np.flatnonzero((symbols < 0) | (symbols >= v.size))
    if not len(odd):
        return symbols, sizes
    spelled = [chr(-1 - s if s < 0 else v.point[s]).encode() for s in symbols[odd].tolist()]
    widths = np.ones(len(symbols), np.int64)
    widths[odd] = [len(s) for s in spelled]
    out = np.repeat(symbols, widths)
    at = (np.cumsum(widths) - widths)[odd]
    out[ragged(at, widths[odd])] = v.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
    return out, np.add.reduceat(widths, np.cumsum(sizes) - sizes)


def group_ids(parts: list[np.ndarray], v: Vocabulary) -> list[np.ndarray]:
    """Ids of several stretches of code points (none empty), each cut at safe places."""
    points = np.concatenate(parts)
    edge = np.append(True, ~v.joins(points))
    borders = np.cumsum([len(p) for p in parts])
    edge[borders[:-1]] = True
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, len(points)))
    first, like = distinct(points, starts, sizes)
    own = sizes[first]
    symbols = v.symbol[points[ragged(starts[first], own)]]
    long = own > LONG
    inside = np.repeat(long, own)
    out, counts = merged(symbols[~inside], own[~long], v)
    if long.any():
        offsets = np.cumsum(own) - own
        told = [merged_by_heap(symbols[offsets[i] : offsets[i] + own[i]], v) for i in np.flatnonzero(long)]
        short = np.flatnonzero(~long)
        order = np.argsort(np.concatenate([np.repeat(short, counts), np.repeat(np.flatnonzero(long), [len(t) for t in told])]), kind="stable")
        out = np.concatenate([out, *told])[order]
        all_counts = np.zeros(len(own), np.int64)
        all_counts[short], all_counts[long] = counts, [len(t) for t in told]
        counts = all_counts
    out, counts = ids_of(out, counts, v)
    offsets = np.cumsum(counts) - counts
    ids = out[ragged(offsets[like], counts[like])]
    per_part = np.add.reduceat(counts[like], np.searchsorted(starts, np.append(0, borders[:-1])))
    return np.split(ids, np.cumsum(per_part)[:-1])


def safe_parts(points: np.ndarray, v: Vocabulary, group: int = GROUP) -> Iterator[np.ndarray]:
    """Stretches of about ``group`` characters; longer only where no safe place comes before."""
    start, at = 0, group
    while at < len(points):
        window = points[at - 1 : at + 4096]
        safe = np.flatnonzero(~v.joins(window)) if len(window) > 1 else ()
        if len(safe):
            at += int(safe[0])
            yield points[start:at]
            start, at = at, at + group
        else:
            at += 4096
    if start < len(points):
        yield points[start:]


def texts_ids(texts: list[str | None], v: Vocabulary, group: int = GROUP) -> list[np.ndarray]:
    """Ids of each text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        for owner, ids in zip(owners, group_ids(held, v) if held else ()):
            found[owner].append(ids)
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        points = np.frombuffer(v.library.normalize(text).encode("utf-32-le"), "<u4") if text else np.empty(0, "<u4")
        for part in safe_parts(points, v, group):
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= group:
                flush()
                size = 0
    flush()
    return [np.concatenate(parts) if parts else np.empty(0, np.int32) for parts in found]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens`` and ``ids``, an array."""
    schema = T.StructType(
        [field_of(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for start, end in slices(batch, lengths):
                part = batch.slice(start, end - start)
                ids = texts_ids(part.column(1).to_pylist(), v)
                counts = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                flat = pa.array(np.concatenate(ids), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.ListArray.from_arrays(offsets, flat)], names=schema.names
                )

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text that the model's library makes of the ids; bytes that are no characters become marks."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    at = encoded.columns.index(ids_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(model_path).library
        for batch in batches:
            counts = pa.compute.list_value_length(batch.column(at)).fill_null(0).to_pylist()
            for start, end in slices(batch, (4 * n for n in counts)):
                part = batch.slice(start, end - start)
                texts = [library.decode(ids) if ids else "" for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
