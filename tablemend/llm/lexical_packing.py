"""Packing of documents into training sequences by lexical retrieval.

Each document is dealt to shards by one of its words, drawn so that telling words win and equal words draw alike:
documents on one subject meet, and a word or a text that a third of all documents share spreads over as many shards as
its bytes need, by hashes of the text, then of the row. The draw weighs words by frequencies in ``SLOTS`` slots of hashed
words. A shard holds about ``SHARD_BYTES`` of text and is one BM25 index, whatever its size: its texts are sorted and its
postings lie in the memory of its task, its ids in a temporary file.
BM25 weighs words by the number of all documents that hold them, counted by word and joined to the shards that need it.

A seed fills its window; while there is room, the index returns the unused documents nearest to the seed by all of its
words, best first; the one that does not fit is cut, and what is left of it seeds the next window. Documents without a
neighbour follow in the shard's order, so no window stays open: only the tail of a shard is short, and it is cut into
sequences whose lengths are powers of two. Nothing is padded and no token is lost. Shards do not ask each other, since
which documents are unused is known in order only.

Ids are those of the tokenizers library. Those of plain byte-level BPE follow from its ranks alone (``ids_of``). Texts of
other tokenizers are cut before white space that follows another character, where no token can span (see ``byte_bpe``),
and the ids of such pieces are kept per worker, up to ``CACHE`` pieces.

Rows: NULL text is the empty text, whose ids are the closing id alone. Repeated rows and ids are documents of their
own. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .blocks import U64, mix, unpacked, word_hashes
from .common import BATCH_ROWS, BLANK, field_of, keeps, lean, saved, slices

WINDOW, CLOSING = 1024, 0
#: slots of hashed words: the size of what is broadcast, 8 bytes each, whatever the size of the corpus
SLOTS = 1 << 18
#: text bytes of a shard, from which the number of shards follows
SHARD_BYTES = 16 << 20
#: text bytes that a task deals to shards at a time, and bytes that a document counts for besides its text
DEAL_BYTES, ROW_BYTES = 16 << 20, 64
#: documents and text bytes that are indexed at a time
INDEX_ROWS, INDEX_BYTES = 2048, 2 << 20
#: pieces whose ids a worker keeps, and the marks that are looked up apart from the word before them
CACHE, MARKS = 500_000, ".,;:!?"
_K, _B = 1.2, 0.75


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


#: ids of pieces by what follows their leading space, and of pieces without one
_spaced: dict[str, bytes] = {}
_plain: dict[str, bytes] = {}
keeps(__name__, _spaced, _plain)
_BEFORE_SPACE = [blank + " " for blank in BLANK]


def pieces(text: str) -> list[str]:
    """Cuts before each space that follows a character other than white space."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if out[-1] and out[-1][-1] not in BLANK:
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


def _fresh(pieces_: list[str], path: str) -> list[bytes]:
    found = _tokenizer(path).encode_batch_fast(pieces_, add_special_tokens=False)
    return [np.array(f.ids, "<u4").tobytes() for f in found]


def _marks(piece: str) -> tuple[str, str]:
    """A piece before and from its trailing marks; no token spans a letter or digit and a mark after it."""
    core = piece.rstrip(MARKS)
    return (core, piece[len(core) :]) if core and core[-1].isalnum() else (piece, "")


def _learn(missing: set[str], lead: str, known: dict[str, bytes], path: str, cache: int) -> dict[str, bytes]:
    """Ids of pieces that are not known: without their trailing marks where that is known, else encoded."""
    parts = {p: _marks(p) for p in missing}
    cores = [c for c in {core for core, _ in parts.values()} if c not in known]
    some = dict(zip(cores, _fresh([lead + c for c in cores], path), strict=True)) if cores else {}
    marks = [m for m in {m for _, m in parts.values()} if m and m not in _plain]
    if marks:
        _plain.update(zip(marks, _fresh(marks, path), strict=True))
    found = {}
    for piece, (core, mark) in parts.items():
        found[piece] = (known[core] if core in known else some[core]) + (_plain[mark] if mark else b"")
    for more in (some, found):
        room = cache - len(known)
        known.update(list(more.items())[: max(room, 0)] if len(more) > room else more)
    return found


def encoded(texts: list[str | None], path: str, cache: int = CACHE) -> list[bytes]:
    """Ids of texts, each with the closing id, as little-endian unsigned 32-bit integers.

    The first ``cache`` pieces that a worker meets are kept: frequent ones come early.
    """
    heads: list[list[str]] = []
    rests: list[list[str]] = []
    for text in texts:
        if not text:
            heads.append([])
            rests.append([])
        elif text[0] == " " or any(blank in text for blank in _BEFORE_SPACE):
            heads.append(pieces(text))
            rests.append([])
        else:
            first, *rest = text.split(" ")
            heads.append([first])
            rests.append(rest)
    out: list[list[bytes]] = []
    for lead, known, rows in (("", _plain, heads), (" ", _spaced, rests)):
        ids = [list(map(known.get, row)) for row in rows]
        gaps = [at for at, row in enumerate(ids) if None in row]
        missing = {p for at in gaps for p, i in zip(rows[at], ids[at], strict=True) if i is None}
        found = _learn(missing, lead, known, path, cache) if missing else {}
        for at in gaps:
            ids[at] = [found[p] if i is None else i for p, i in zip(rows[at], ids[at], strict=True)]
        out = [a + b for a, b in zip(out, ids, strict=True)] if out else ids
    closing = np.array([CLOSING], "<u4").tobytes()
    return [b"".join(row) + closing for row in out]


#: what the library's byte-level splitting matches
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _codec(path: str) -> tiktoken.Encoding | None:
    """The ranks of a tokenizer that is plain byte-level BPE with ids in the order of its merges; else None."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told.get("model") or {}, told.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd) or any(told.get(k) for k in ("normalizer", "truncation", "padding")):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if any(not token.get("special") or token.get("normalized") for token in told.get("added_tokens") or []):
        return None
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(seen))}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = model["vocab"]
    if not all(c in ids for c in byte) or not all(m in ids and all(c in byte for c in m) for m in merged):
        return None
    if any(a >= b for a, b in pairwise(ids[m] for m in merged)) or (merged and max(ids[c] for c in byte) > ids[merged[0]]):
        return None
    return tiktoken.Encoding("packing", pat_str=_SPLIT, mergeable_ranks={bytes(byte[c] for c in t): ids[t] for t in [*byte, *merged]}, special_tokens={})


def ids_of(texts: list[str | None], path: str, cache: int = CACHE) -> list[bytes]:
    """As ``encoded``, by the ranks alone where these give the same ids: a text is then encoded at once and nothing is kept."""
    codec = _codec(path)
    if codec is None:
        return encoded(texts, path, cache)
    closing, out = np.array([CLOSING], "<u4").tobytes(), []
    for text in texts:
        try:
            ids = codec.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""
        except ValueError:  # more blanks in a row than its pattern can go back over
            ids = _fresh([text], path)[0]
        out.append(ids + closing)
    return out


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs of some texts with their counts, and the words of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = word_hashes(b"\n".join(raw))
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), places, side="right")
    both, times = np.unique(doc * SLOTS + (hashes % U64(SLOTS)).astype(np.int64), return_counts=True)
    return both // SLOTS, both % SLOTS, times, np.bincount(doc, minlength=len(raw))


def _distinct(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text in the order of their hashes: hash, text and count; and the words of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = word_hashes(b"\n".join(raw))
    first = np.searchsorted(places, np.cumsum([0, *[len(r) + 1 for r in raw]]))
    for low, high in pairwise(first.tolist()):
        hashes[low:high].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[first[first < len(hashes)]] = True
    at = np.flatnonzero(new)
    sizes = np.diff(first)
    return hashes[at], np.repeat(np.arange(len(raw)), sizes)[at], np.diff(np.append(at, len(hashes))), sizes


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int, float, int]:
    """Document frequency of each slot, number of documents, mean words of a document, characters; over all documents."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS + 3, np.int64)
        for batch in batches:
            sizes = pc.utf8_length(batch.column(0)).fill_null(0).to_pylist()
            for start, end in slices(batch, sizes):
                _, slot, _, words = _terms(batch.column(0).slice(start, end - start).to_pylist())
                counts[:SLOTS] += np.bincount(slot, minlength=SLOTS)
                counts[SLOTS] += end - start
                counts[SLOTS + 1] += words.sum()
                counts[SLOTS + 2] += sum(sizes[start:end])
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"])

    rows = docs.select(text_col).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(SLOTS + 3, np.int64)
    table = rows.toArrow()  # SLOTS + 3 rows at most
    found[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return found[:SLOTS], int(found[SLOTS]), float(found[SLOTS + 1]) / max(int(found[SLOTS]), 1), int(found[SLOTS + 2])


def _weights(frequency: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency; words of one document tell nothing about another."""
    return np.where(frequency > 1, np.log1p((n - frequency + 0.5) / (frequency + 0.5)), 0.0)


class Spill:
    """Bytes in a temporary file without a name, appended and read by place."""

    def __init__(self):
        self.file, self.size = tempfile.TemporaryFile(buffering=0), 0  # noqa: SIM115

    def add(self, data: bytes) -> int:
        at, view = self.size, memoryview(data)
        while view:
            view = view[self.file.write(view) :]
        self.size += len(data)
        return at

    def read(self, at: int, size: int) -> bytes:
        found = os.pread(self.file.fileno(), size, at)
        while len(found) < size:
            found += os.pread(self.file.fileno(), size - len(found), at + len(found))
        return found

    def close(self) -> None:
        self.file.close()


class Index:
    """BM25 over any number of documents, with corpus-wide weights of words.

    ``idf`` has the weights of the sorted hashes ``words``, or of slots where these are not given; other words count
    nothing. Postings of used documents are dropped as soon as these are a quarter of all.
    """

    def __init__(self, texts: list[str | None], idf: np.ndarray, mean: float, words: np.ndarray | None = None):
        self.idf, self.mean, self.words = idf, mean, words
        self.parts: list[tuple] = []
        self.start = [0]
        if texts:
            self.add(texts)
            self.build()

    def add(self, texts: list[str | None]) -> None:
        hashes, doc, times, sizes = _distinct(texts)
        if self.words is None:
            doc, word, times, _ = _terms(texts)
        elif len(self.words):
            word = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[word] == hashes
            word, doc, times = word[known], doc[known], times[known]
        else:
            word, doc, times = (np.empty(0, np.int64) for _ in range(3))
        self.start += (self.start[-1] + np.searchsorted(doc, np.arange(1, len(texts) + 1))).tolist()
        weight = self.idf[word] * times * (_K + 1) / (times + _K * (1 - _B + _B * sizes[doc] / max(self.mean, 1.0)))
        self.parts.append((word.astype(np.int32), weight.astype(np.float32)))

    def build(self) -> None:
        """Gather the postings of each word."""
        self.word = np.concatenate([np.empty(0, np.int32), *[w for w, _ in self.parts]])
        weight = np.concatenate([np.empty(0, np.float32), *[w for _, w in self.parts]])
        self.parts.clear()
        self.start = np.array(self.start)
        by = np.argsort(self.word, kind="stable")
        self.doc = np.repeat(np.arange(len(self.start) - 1, dtype=np.int32), np.diff(self.start))[by]
        self.weight = weight[by]
        self.range = np.cumsum(np.append(0, np.bincount(self.word, minlength=len(self.idf))))
        self.indexed = len(self.start) - 1
        self.unused = np.ones(self.indexed, bool)

    def _dropped(self) -> None:
        """Keep the postings of unused documents only."""
        kept = self.unused[self.doc]
        self.range = np.append(0, np.cumsum(kept))[self.range]
        self.doc, self.weight, self.indexed = self.doc[kept], self.weight[kept], np.count_nonzero(self.unused)

    def _scores(self, seed: int) -> np.ndarray:
        word = self.word[self.start[seed] : self.start[seed + 1]]
        word = word[self.idf[word] > 0]
        spans = [slice(a, b) for a, b in zip(self.range[word].tolist(), self.range[word + 1].tolist(), strict=True) if a < b]
        if not spans:
            return np.zeros(len(self.unused))
        return np.bincount(
            np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.unused)
        )

    def ranked(self, seed: int, few: int = 32) -> Iterator[np.ndarray]:
        """Unused documents that share words with the seed, best first: the first few, then all others."""
        if 4 * np.count_nonzero(self.unused) < 3 * self.indexed:
            self._dropped()
        scores = self._scores(seed)
        found = np.flatnonzero((scores > 0) & self.unused)
        if len(found) > 2 * few:
            own = scores[found]
            best = own >= np.partition(own, len(own) - few)[len(own) - few]
            first, found = found[best], found[~best]
            yield first[np.argsort(-scores[first], kind="stable")]
        yield found[np.argsort(-scores[found], kind="stable")]

    def nearest(self, seed: int) -> np.ndarray:
        """Unused documents that share words with the seed, best first."""
        return np.concatenate(list(self.ranked(seed)))


def order(texts: list[str | None], sizes: list[int], idf: np.ndarray, mean: float, room: int) -> Iterator[int]:
    """Documents of one index in the order in which they fill windows; ``room`` is what is left of the first."""
    return walk(Index(texts, idf, mean), sizes, room)


def walk(index: Index, sizes: list[int], room: int) -> Iterator[int]:
    """Documents of an index in the order in which they fill windows."""
    ahead = 0
    left = len(sizes)
    while left:
        while not index.unused[ahead]:
            ahead += 1
        seed = ahead
        index.unused[seed] = False
        yield seed
        left -= 1
        while left:
            room = (room - sizes[seed]) % WINDOW
            last = seed
            if room:
                for at in (int(at) for some in index.ranked(seed) for at in some):
                    index.unused[at] = False
                    yield at
                    left -= 1
                    last = at
                    if sizes[last] >= room:
                        break
                    room -= sizes[last]
            if last == seed:
                break
            seed = last  # cut at the end of the window: what is left of it seeds the next
            room = room if sizes[last] >= room else room + sizes[last]


def tail(length: int) -> list[int]:
    """Lengths of the sequences that a shard's tail is cut into: powers of two, largest first."""
    return [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1]


class Packer:
    """Cuts a stream of encoded documents into full sequences and, at its end, into powers of two."""

    def __init__(self, first: int):
        self.sequence, self.held, self.open = first, 0, []

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while start < total:
            length = min(total - start, WINDOW - self.held)
            self.open.append((key, start, length, ids[4 * start : 4 * (start + length)], total))
            start, self.held = start + length, self.held + length
            if self.held == WINDOW:
                yield from self._closed([WINDOW])

    def _closed(self, lengths: list[int]) -> Iterator[tuple]:
        rows, self.open, self.held = self.open[::-1], [], 0
        for length in lengths:
            offset = 0
            while offset < length:
                key, start, size, ids, total = rows.pop()
                taken = min(size, length - offset)
                yield key, start, taken, zlib.crc32(ids[: 4 * taken]), total, self.sequence, offset
                offset += taken
                if taken < size:
                    rows.append((key, start + taken, size - taken, ids[4 * taken :], total))
            self.sequence += 1

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield from self._closed(tail(self.held))


def _routes(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Of each text, the least of its words' draws, in which a word's chance grows with what it tells.

    Equal words draw alike everywhere, so texts that share telling words often have the same route.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = word_hashes(b"\n".join(raw))
    found = np.full(len(raw), np.inf)
    if len(hashes):
        first = np.searchsorted(places, np.cumsum([0, *[len(r) + 1 for r in raw]]))
        chance = ((hashes >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
        with np.errstate(divide="ignore"):
            draws = -np.log(chance) / idf[(hashes % U64(SLOTS)).astype(np.int64)]
        some = np.flatnonzero(np.diff(first) > 0)
        found[some] = np.minimum.reduceat(draws, first[some])
    return found


def _weighed(docs: DataFrame, text_col: str, idf) -> DataFrame:
    """Of each document its route, the hash of its text and its bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch, batch.column(2).to_pylist()):
                part = batch.slice(start, end - start)
                routes = pa.array(_routes(part.column(0).to_pylist(), idf.value))
                yield pa.RecordBatch.from_arrays([routes, *part.columns[1:]], names=["__route", "__hash", "__bytes"])

    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES
    rows = docs.select(text.alias("__text"), F.xxhash64(text).alias("__hash"), size.alias("__bytes"))
    return rows.mapInArrow(run, "__route double, __hash bigint, __bytes bigint")


def _bits(routes) -> np.ndarray:
    return mix(np.asarray(routes, np.float64).view(np.uint64))


def _hashed(values) -> np.ndarray:
    return mix(np.asarray(values, np.int64).view(np.uint64))


class Shares:
    """The shard of each document: by its route, and where that has much text by the text, and where that has many copies by the row.

    Routes and texts with more than a quarter of a shard (eight a shard at most) are cut into such parts, each of which goes to the
    shard with the least of them, the largest first.
    """

    def __init__(self, shards: int, routes: dict, texts: dict, quarter: int):
        self.shards = shards
        parts = []
        for kind, found in enumerate((routes, texts)):
            for key in sorted(found):
                n = -(-found[key] // quarter)
                parts += [(-(found[key] // n), kind, key, k) for k in range(n)]
        load = [(0, k) for k in range(shards)]
        to = {}
        for size, kind, key, k in sorted(parts):
            held, shard = heapq.heappop(load)
            to[kind, key, k] = shard
            heapq.heappush(load, (held - size, shard))
        self.kinds = []
        for kind, found in enumerate((routes, texts)):
            keys = np.array(sorted(found), np.uint64)
            n = np.array([-(-found[int(k)] // quarter) for k in keys], np.int64)
            shard = np.array([to[kind, int(key), k] for key, m in zip(keys, n.tolist(), strict=True) for k in range(m)], np.int64)
            self.kinds.append((keys, n, np.cumsum(n) - n, shard))

    def of(self, routes, hashes, rows) -> np.ndarray:
        by_route, by_text, by_row = _bits(routes), _hashed(hashes), _hashed(rows)
        found = (by_route % U64(self.shards)).astype(np.int64)
        for (keys, n, first, shard), own, within in zip(self.kinds, (by_route, by_route ^ by_text), (by_text, by_row), strict=True):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                some = keys[at] == own
                at = at[some]
                found[some] = shard[first[at] + (within[some] % n[at].astype(np.uint64)).astype(np.int64)]
        return found


def _shares(docs: DataFrame, text_col: str, idf, shards: int, chars: int, n: int) -> Shares:
    """Routes and texts that are more than a quarter of a mean shard come to the driver: a few for each shard."""
    quarter = max((chars + n * ROW_BYTES) // (4 * shards), 1)
    texts = _weighed(docs, text_col, idf).groupBy("__route", "__hash").agg(F.sum("__bytes").alias("__bytes"))
    much = F.col("__bytes") >= quarter
    routes = texts.groupBy("__route").agg(
        F.sum(F.when(~much, F.col("__bytes"))).alias("rest"), F.collect_list(F.when(much, F.struct("__hash", "__bytes"))).alias("texts")
    )
    found = routes.where((F.col("rest") >= quarter) | (F.size("texts") > 0)).collect()
    heavy = {int(_bits([r[0]])[0]): r[1] for r in found if r[1] is not None and r[1] >= quarter}
    copies = {int((_bits([r[0]]) ^ _hashed([t[0]]))[0]): t[1] for r in found for t in r[2]}
    return Shares(shards, heavy, copies, quarter)


def _dealt(docs: DataFrame, id_col: str, text_col: str, idf, shares: Shares) -> DataFrame:
    """Documents by shard, those of a task and shard together in compressed blocks."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        held: list[pa.RecordBatch] = []
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            shard = rows.column("__shard").to_numpy()
            by = np.argsort(shard, kind="stable")
            rows = rows.drop_columns(["__shard"])
            edges = np.flatnonzero(np.diff(shard[by], prepend=-1, append=-1))
            for low, high in pairwise(edges.tolist()):
                sink = pa.BufferOutputStream()
                part = rows.take(pa.array(by[low:high])).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_table(part)
                data = press.compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard[by[low]]], pa.int32()), pa.array([data], pa.binary())], names=["__shard", "__data"]
                )

        for batch in batches:
            sizes = [len(t.as_py() or "") for t in batch.column(1)]
            for start, end in slices(batch, sizes):
                part = batch.slice(start, end - start)
                routes = _routes(part.column(1).to_pylist(), idf.value)
                shard = shares.value.of(routes, part.column(2).to_numpy(), part.column(4).to_numpy())
                own = [*part.columns, pa.array(routes), pa.array(shard, pa.int32())]
                held.append(pa.RecordBatch.from_arrays(own, names=[*_DEALT, "__shard"]))
                size += sum(sizes[start:end])
                if size > DEAL_BYTES:
                    yield from told()
                    size = 0
        if held:
            yield from told()

    text = F.col(text_col)
    rows = docs.select(
        id_col, text.alias("__text"), F.xxhash64(text).alias("__hash"), F.xxhash64(id_col).alias("__key"), F.monotonically_increasing_id().alias("__row")
    )
    return rows.mapInArrow(run, "__shard int, __data binary")


_DEALT = ["__id", "__text", "__hash", "__key", "__row", "__route"]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one shard from its blocks, by route, text, id and row."""
    tables = [unpacked(data.as_py()) for batch in batches for data in batch.column(1)]
    if tables:
        rows = pa.concat_tables(tables).combine_chunks()
        tables.clear()
        rows = rows.sort_by([(c, "ascending") for c in ("__route", "__hash", "__key", "__row")])
        yield from rows.select(["__id", "__text"]).to_batches(max_chunksize=BATCH_ROWS)


class Counted:
    """Number of documents that hold each word."""

    def __init__(self):
        self.words, self.n, self.more, self.held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, texts: list[str | None]) -> None:
        words, n = np.unique(_distinct(texts)[0], return_counts=True)
        self.more.append((words, n))
        self.held += len(words)
        if self.held > max(1 << 18, len(self.words)):
            self.merge()

    def merge(self) -> None:
        words = np.concatenate([self.words, *[w for w, _ in self.more]])
        n = np.concatenate([self.n, *[n for _, n in self.more]])
        by = np.argsort(words)
        words, first = np.unique(words[by], return_index=True)
        self.words, self.n = words, np.add.reduceat(n[by], first).astype(np.int64) if len(words) else np.empty(0, np.int64)
        self.more, self.held = [], 0


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, so that bytes that are alike lie together."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _restored(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sharded(rows: DataFrame, parts: int = 16, packed: bool = False) -> DataFrame:
    """Of each partition, its number, its documents in compressed blocks, and its words with their numbers of documents.

    Words come in ranges of their hashes, numbered -1 and down as places. ``packed`` rows are those of ``_dealt``.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=3)
        counted, place = Counted(), 0

        def row(at: int, data: bytes, n: bytes | None) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip((shard, at, data, n), kinds, strict=True)], names=["__shard", "__place", "__data", "__n"]
            )

        for batch in _in_order(batches) if packed else batches:
            for start, end in slices(batch, [len(t.as_py() or "") for t in batch.column(1)]):
                part = batch.slice(start, end - start)
                counted.add(part.column(1).to_pylist())
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                yield row(place, press.compress(sink.getvalue().to_pybytes()), None)
                place += 1
        if place:
            counted.merge()
        edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        cuts = [0, *np.searchsorted(counted.words, edges).tolist(), len(counted.words)]
        for k, (low, high) in enumerate(pairwise(cuts)):
            if low < high:
                words = counted.words[low:high]
                yield row(-1 - k, _squeezed(np.diff(words, prepend=U64(0))), _squeezed(counted.n[low:high].astype("<u4")))

    return saved(rows.mapInArrow(run, "__shard int, __place bigint, __data binary, __n binary"), "shards")


def frequencies(sharded: DataFrame, parts: int = 16) -> DataFrame:
    """Of each shard, the words that several of its documents hold, with the number of all documents that hold them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True)]
        held = [(shard, np.cumsum(_restored(words, "<u8"), dtype=np.uint64), _restored(n, "<u4")) for shard, words, n in held]
        if not held:
            return
        total = Counted()
        total.more = [(words, n) for _, words, n in held]
        total.merge()
        for shard, words, n in held:
            words = words[n > 1]
            df = total.n[np.searchsorted(total.words, words)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(words), shard, np.int32)), pa.array(words.view(np.int64)), pa.array(df)], names=["__shard", "__word", "__df"]
            )

    rows = sharded.where("__place < 0").select((-1 - F.col("__place")).cast("int").alias("__part"), "__shard", "__data", "__n")
    return rows.repartitionById(parts, "__part").mapInArrow(run, "__shard int, __word bigint, __df bigint")


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    frequency, n, mean, chars = statistics(docs, text_col)
    idf = spark.sparkContext.broadcast(_weights(frequency, n))
    schema = T.StructType(
        [
            field_of(docs, id_col),
            *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        ]
    )
    key_type = pa.int64()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32)
        words: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        index: Index | None = None
        keys: list = []
        ids, first = Spill(), [0]
        texts: list = []
        held = 0
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *[pa.array(c, key_type) for c in columns[1:]]], names=schema.names
            )

        def indexed() -> Index:
            found = index
            if found is None:
                all_words = np.concatenate([np.empty(0, np.int64), *words]).view(np.uint64)
                by = np.argsort(all_words)
                weights = _weights(np.concatenate([np.empty(0, np.int64), *counts])[by], n)
                found = Index([], weights, mean, all_words[by])
                words.clear()
                counts.clear()
            found.add(texts)
            for start in range(0, len(texts), 256):
                for own in ids_of(texts[start : start + 256], tokenizer_path, cache):
                    ids.add(own)
                    first.append(ids.size)
            texts.clear()
            return found

        kind = None
        for batch in batches:
            told_words = int(np.count_nonzero(batch.column(0).to_numpy() < 0))
            if told_words:  # these come before the documents
                words.append(batch.column(2).slice(0, told_words).to_numpy().astype(np.int64))
                counts.append(batch.column(3).slice(0, told_words).to_numpy().astype(np.int64))
            for packed in batch.column(1).slice(told_words):
                block = unpacked(packed.as_py())
                kind = block.schema.field(0).type
                more = block.column(1).to_pylist()
                size = sum(len(t or "") for t in more)
                if texts and (held + size > INDEX_BYTES or len(texts) + len(more) > INDEX_ROWS):
                    index, held = indexed(), 0
                keys += block.column(0).to_pylist()
                texts += more
                held += size
        if texts:
            index = indexed()
        if index is not None:
            index.build()
            sizes = [(b - a) // 4 for a, b in zip(first, first[1:], strict=False)]
            for at in walk(index, sizes, WINDOW):
                out.extend(packer.add(keys[at], ids.read(first[at], first[at + 1] - first[at])))
                if len(out) >= 4096:
                    yield told()
        ids.close()
        out.extend(packer.end())
        if out:
            yield told()

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_BYTES))
    shares = spark.sparkContext.broadcast(_shares(docs, text_col, idf, shards, chars, n))
    dealt = _dealt(docs, id_col, text_col, idf, shares).repartitionById(shards, "__shard")
    sharded = _sharded(dealt, shards, packed=True)
    none = F.lit(None).cast("bigint")
    documents = sharded.where("__place >= 0").select("__shard", "__place", "__data", none.alias("__word"), none.alias("__df"))
    empty = [F.lit(-1).cast("bigint"), F.lit(None).cast("binary")]
    rows = documents.unionAll(frequencies(sharded, shards).select("__shard", *empty, "__word", "__df"))
    together = rows.repartitionById(shards, "__shard").sortWithinPartitions("__place")
    return together.select("__place", "__data", "__word", "__df").mapInArrow(run, schema)
