"""Similarity join of texts on their sets of word n-grams, by a forest of min-hash tries.

Every text has a label of ``LONGEST`` min-hashes in each of ``TREES`` trees. A tree is the sorted table of its labels: a
run of labels with a common prefix is a node of its trie. Texts first meet where whole labels agree. Then prefixes are
shortened: the links that were verified tell how alike the texts of this corpus are, and ``shortened`` takes the longest
prefix at which links of every band of similarity that occurs meet with the wanted probability. A band without a link counts
as empty only if what may be hidden there is less than the wanted recall leaves of all links, so small or sparse tables go
to the prefix that serves the threshold itself (four values at 0.8, where 99.8 % of such pairs meet). New links may show
weaker bands, so this is repeated until no prefix gets shorter. At each length only nodes that join several nodes of the
length before are opened, and only pairs that have not met are judged, by the exact Jaccard similarity of their whole sets.

Texts with equal sets are one class and join once; their number weighs its links. A pair that meets in several trees is
judged in the first, at the longest prefix. A group that meets is verified within one task in blocks of ``MEMBERS``: a larger group is cut
into parts, and each pair of parts is a task of its own. A task returns each member's number of links and a forest that
connects the linked ones, never the pairs. Links then connect to classes by star contraction.

Rows: a text of fewer words than an n-gram has the sequence of its words as its only element; NULL and empty texts are
equal. Repeated rows and ids are documents of their own. An empty table gives no rows. The class is known by its least
id (NULL ids last). Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_ROWS, OTHER, PRIME, U64, mix, powers, to_blocks, unpacked, word_hashes
from .common import field_of, lean, saved

NGRAM, SIMILARITY, RECALL = 5, 0.8, 0.995
#: trees, and values of a label before its prefix is shortened; a value has 16 bits
TREES, LONGEST = 12, 8
_LABEL = 2 * LONGEST
#: bands of similarity from the threshold to 1 that links are counted in
BANDS = 8
#: links that a band may hold although none was found (at 95 %, the rule of three)
UNSEEN = 3
#: members of a group, or of a part of one, that a task holds two times at most
MEMBERS = 256
#: columns of the incidence matrix that are multiplied at a time, and bytes of text that are hashed at a time
_COLUMNS, _BYTES = 4096, 1 << 20

_FACTORS = mix(np.arange(1, TREES * LONGEST + 1, dtype=np.uint64) * OTHER) | U64(1)
_TERMS = mix(np.arange(1, TREES * LONGEST + 1, dtype=np.uint64) * PRIME)


def chance(similarity: float, length: int, trees: int = TREES) -> float:
    """Probability that a pair of a similarity meets in some tree at a prefix of some length."""
    return 1 - (1 - similarity**length) ** trees


def depth(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix at which pairs of a similarity still meet in some tree with the wanted probability."""
    length = LONGEST
    while length > 1 and chance(similarity, length, trees) < recall:
        length -= 1
    return length


def shortened(seen: list[int], length: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix, of ``length`` values at most, that reaches the recall for links as they were seen.

    ``seen`` has the links of each band of similarity that were verified at ``length``, weakest band first.
    """
    edges = [similarity + (1 - similarity) * band / BANDS for band in range(BANDS)]
    hidden = [0 if n else UNSEEN / chance(edge, length) for edge, n in zip(edges, seen, strict=True)]

    def enough(at: int) -> bool:
        missed = [1 - chance(edge, at) for edge in edges]
        return all(
            m <= 1 - recall or (not n and h * m <= (1 - recall) * sum(seen))
            for m, n, h in zip(missed, seen, hidden, strict=True)
        )

    while length > 1 and not enough(length):
        length -= 1
    return length


def shingles(texts: list[str | None], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some texts, and where each text's begin (one more for the end)."""
    return _shingles([(t or "").encode("utf-8", "surrogatepass") for t in texts], n)


def _shingles(raw: list[bytes], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    words, places = word_hashes(b"\n".join(raw))
    counts = np.bincount(np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), places, side="right"), minlength=len(raw))
    starts = np.append(0, np.cumsum(counts))
    full = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for at, power in enumerate(powers(PRIME, n)):
        full += words[at : at + len(full)] * power
    sizes = np.maximum(counts - n + 1, 1)
    begin = np.append(0, np.cumsum(sizes))
    out = np.zeros(begin[-1], np.uint64)
    long = counts >= n
    # places of all n-grams of the long texts, one text after the other
    within = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
    place = np.repeat(starts[:-1], sizes) + within
    of_long = np.repeat(long, sizes)
    out[of_long] = full[place[of_long]]
    for at in np.flatnonzero(~long):
        own = words[starts[at] : starts[at + 1]]
        out[begin[at]] = (own * powers(OTHER, len(own) + 1)[1:]).sum(dtype=np.uint64) + U64(len(own))
    return mix(out), begin


def sets_of(raw: list[bytes]) -> list[np.ndarray]:
    """The set of n-grams of each text in UTF-8, as sorted hashes."""
    sets: list[np.ndarray] = []
    while len(sets) < len(raw):
        first = last = len(sets)
        size = 0
        while last < len(raw) and (last == first or size + len(raw[last]) <= _BYTES):
            size += len(raw[last])
            last += 1
        hashes, begin = _shingles(raw[first:last])
        sets += [np.unique(hashes[a:b]) for a, b in zip(begin, begin[1:], strict=False)]
    return sets


def labels(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per text, tree and place, 16 bits of a min-hash; the bytes of a label sort as its values do."""
    found = np.empty((len(begin) - 1, TREES, LONGEST), ">u2")
    for at in range(TREES * LONGEST):
        least = np.minimum.reduceat(hashes * _FACTORS[at] + _TERMS[at], begin[:-1])
        found[:, at // LONGEST, at % LONGEST] = mix(least) & U64(0xFFFF)
    return found


def prefixes(found: np.ndarray, length: int) -> np.ndarray:
    """Per text and tree, a number that is equal where the first ``length`` values of the labels are."""
    _, number = np.unique(np.ascontiguousarray(found[:, :, :length]).view(f"V{2 * length}").ravel(), return_inverse=True)
    return number.reshape(found.shape[:2])


def _signed(blocks: DataFrame, id_field: T.StructField) -> DataFrame:
    """Per document: key, id, two hashes of its set, and its labels, one after the other."""
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            id_field,
            T.StructField("set_a", T.LongType()),
            T.StructField("set_b", T.LongType()),
            T.StructField("labels", T.BinaryType()),
        ]
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0), batch.column(1), strict=True):
                table = unpacked(rows.as_py())
                if not table.num_rows:
                    continue
                hashes, begin = shingles(table.column(1).to_pylist())
                own_labels = labels(hashes, begin)
                sets = np.empty((table.num_rows, 2), np.uint64)
                for at in range(table.num_rows):
                    own = np.unique(hashes[begin[at] : begin[at + 1]])
                    sets[at] = mix(own * PRIME).sum(dtype=np.uint64), mix(own * OTHER).sum(dtype=np.uint64)
                keys = number.as_py() * BLOCK_ROWS + np.arange(table.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        table.column(0).combine_chunks(),
                        pa.array(sets[:, 0].view(np.int64)),
                        pa.array(np.ascontiguousarray(sets[:, 1]).view(np.int64)),
                        pa.array([row.tobytes() for row in own_labels], pa.binary()),
                    ],
                    names=schema.names,
                )

    return blocks.select("block", "rows").mapInArrow(run, schema)


def _members(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of wanted rows, compressed, one row for each task that verifies them."""
    schema = "tree int, path bigint, low int, high int, part int, key bigint, weight bigint, labels binary, packed binary"
    names = [c.split()[0] for c in schema.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for rows, wants in zip(batch.column(0), batch.column(1), strict=True):
                texts = unpacked(rows.as_py()).column(1)
                for want in wants.as_py():
                    text = texts[want["key"] % BLOCK_ROWS].as_py() or ""
                    own = (want["key"], want["weight"], want["labels"], press.compress(text.encode("utf-8", "surrogatepass")))
                    out = [
                        (m["tree"], m["path"], min(part, m["part"]), max(part, m["part"]), m["part"], *own)
                        for m in want["meets"]
                        for part in range(m["parts"])
                    ]
                    for at in range(0, len(out), 64):
                        columns = [pa.array(list(c)) for c in zip(*out[at : at + 64], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [c.cast(pa.int32()) if n in ("tree", "low", "high", "part") else c for n, c in zip(names, columns, strict=True)],
                            names=names,
                        )

    per_block = wanted.groupBy(F.floor(F.col("key") / BLOCK_ROWS).alias("block")).agg(
        F.collect_list(F.struct("key", "weight", "labels", "meets")).alias("wants")
    )
    return blocks.join(per_block, "block").select("rows", "wants").mapInArrow(run, schema)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[column] > 1
    rank = np.cumsum(times > 1) - 1
    of, column = of[common], rank[column[common]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((times > 1).sum()), _COLUMNS):
        low, high = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[of[low:high], column[low:high] - first] = 1
        counts += part @ part.T
    return counts.astype(np.int64)


def verified(
    keys: np.ndarray, weights: np.ndarray, parts: np.ndarray, found: np.ndarray, packed: list[bytes],
    tree: int, low: int, high: int, length: int, before: int, similarity: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of each member, the least member of those it is connected with by links, and its links by band.

    Pairs are judged that meet in this tree at prefixes of ``length`` values, in no earlier one, and in none at ``before``
    values (0: there was no longer prefix). Bands count each pair once, with its first member.
    """
    pairs = np.triu(np.ones((len(keys), len(keys)), bool), 1)
    if low != high:
        pairs &= parts[:, None] != parts[None, :]
    now = prefixes(found, length)
    pairs &= now[:, None, tree] == now[None, :, tree]
    for earlier in range(tree):
        pairs &= now[:, None, earlier] != now[None, :, earlier]
    if before:
        longer = prefixes(found, before)
        for other in range(tree, TREES):
            pairs &= longer[:, None, other] != longer[None, :, other]
    counts = np.zeros(len(keys), np.int64)
    bands = np.zeros((len(keys), BANDS), np.int64)
    root = np.arange(len(keys))
    some = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
    if len(some):
        press = zstandard.ZstdDecompressor()
        sets = sets_of([press.decompress(packed[at]) for at in some])
        sizes = np.array([len(s) for s in sets])
        both = overlaps(sets)
        either = sizes[:, None] + sizes[None, :] - both
        linked = pairs[np.ix_(some, some)] & (both >= similarity * either - 1e-9)
        first, second = np.nonzero(linked)
        share = (both[first, second] / either[first, second] - similarity) / max(1 - similarity, 1e-9)
        np.add.at(bands, (some[first], np.clip((share * BANDS).astype(np.int64), 0, BANDS - 1)), 1)
        linked |= linked.T
        counts[some] = linked @ weights[some]
        own = np.arange(len(some))
        while True:
            least = np.minimum(own, np.where(linked, own[None, :], len(some)).min(axis=1, initial=len(some)))
            if (least == own).all():
                break
            own = least
        root[some] = some[own]
    return counts, root, bands


def _links(members: DataFrame, length: int, before: int, similarity: float) -> DataFrame:
    """Per task and linked member: key, links, a member that it is connected with, and links by band."""
    names = ["key", "links", "other", "bands"]

    def judged(group: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        tree, _, low, high = group
        keys = np.array([r[1] for r in rows], np.int64)
        order = np.argsort(keys, kind="stable")
        rows = [rows[i] for i in order]
        keys = keys[order]
        counts, root, bands = verified(
            keys, np.array([r[2] for r in rows], np.int64), np.array([r[0] for r in rows]),
            np.stack([np.frombuffer(r[3], ">u2").reshape(TREES, LONGEST) for r in rows]), [r[4] for r in rows],
            tree, low, high, length, before, similarity,
        )
        some = np.flatnonzero(counts)
        if not len(some):
            return None
        by_band = pa.ListArray.from_arrays(
            pa.array(np.arange(0, len(some) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands[some].ravel())
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[some]), pa.array(counts[some]), pa.array(keys[root[some]]), by_band], names=names
        )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for tree, path, low, high, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (tree, path, low, high) != group:
                    if len(rows) > 1 and (found := judged(group, rows)) is not None:
                        yield found
                    group, rows = (tree, path, low, high), []
                rows.append(tuple(row))
        if len(rows) > 1 and (found := judged(group, rows)) is not None:
            yield found

    task = ["tree", "path", "low", "high"]
    dealt = members.repartition(*[F.col(c) for c in task]).sortWithinPartitions(*task)
    return dealt.mapInArrow(run, "key bigint, links bigint, other bigint, bands array<bigint>")


def _forest(reps: DataFrame) -> DataFrame:
    """The sorted labels of all trees: tree, label and key; equal labels may lie in several ranges."""
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("labels", t * _LABEL + 1, _LABEL).alias("label")) for t in range(TREES)]))
    walks = reps.select(trees.alias("t"), "key").select("t.tree", "t.label", "key")
    return saved(walks.repartitionByRange("tree", "label", "key").sortWithinPartitions("tree", "label"), "forest")


def _meeting(reps: DataFrame, forest: DataFrame, length: int, before: int) -> DataFrame:
    """Texts in nodes of some depth that join several nodes of the depth before: key, weight, labels and the nodes."""
    at = forest.select("tree", F.xxhash64(F.substring("label", 1, 2 * length)).alias("path"), "key", "label")
    child = F.xxhash64(F.substring("label", 1, 2 * before)) if before else F.col("key")
    nodes = (
        at.groupBy("tree", "path")
        .agg(F.count("*").alias("n"), F.min(child).alias("least"), F.max(child).alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("tree", "path", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("key", "tree"), F.col("parts")).cast("int")
    meets = (
        at.drop("label")
        .join(saved(nodes, "nodes"), ["tree", "path"])
        .withColumn("part", part)
        .groupBy("key")
        .agg(F.collect_list(F.struct("tree", "path", "part", "parts")).alias("meets"))
    )
    return saved(reps.join(meets, "key"), "meeting")


def linked(blocks: DataFrame, reps: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, list[int]]:
    """All verified links (key, links, other) of texts with key, weight and labels, and the lengths of prefixes that were tried."""
    forest = _forest(reps)
    tried, rounds, seen = [], [], [0] * BANDS
    length, before = LONGEST, 0
    while True:
        found = saved(_links(_members(blocks, _meeting(reps, forest, length, before)), length, before, similarity), "links")
        more = found.agg(*[F.sum(F.col("bands")[band]) for band in range(BANDS)]).first()
        seen = [a + (b or 0) for a, b in zip(seen, more, strict=True)]
        rounds.append(found.drop("bands"))
        tried.append(length)
        length, before = shortened(seen, length, similarity, recall), length
        if length == before:
            return reduce(DataFrame.unionAll, rounds), tried


def connected(edges: DataFrame) -> DataFrame:
    """Least key of the connected component of every key (``key``, ``least``), by alternating star contraction."""

    def both_ways(frame: DataFrame) -> DataFrame:
        return frame.select("a", "b").unionAll(frame.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(frame: DataFrame, large: bool) -> DataFrame:
        near = both_ways(frame) if large else frame.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # saved, so that the join deals out both sides anew and can split a key that many neighbours share
        least = saved(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        moved = near.join(least, "a")
        if large:
            moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where(F.col("a") != F.col("b")).distinct()

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        now = saved(star(star(now, True), False), "edges")
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("key"), F.col("b").alias("least"))


def _classes(blocks: DataFrame, id_field: T.StructField, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Per document: key, id, ``least`` key of its class and links; and per class its first document."""
    rows = saved(_signed(blocks, id_field), "signed")
    # documents with equal sets are one member, known by its least key
    sets = saved(
        rows.groupBy("set_a", "set_b").agg(F.min("key").alias("key"), F.count("*").alias("weight")), "sets"
    )
    reps = saved(rows.select("key", "labels").join(sets.select("key", "weight"), "key"), "reps")
    links, _ = linked(blocks, reps, similarity, recall)
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    classes = connected(links.select(F.col("key").alias("a"), F.col("other").alias("b")))
    n_links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    known = (
        sets.join(counts, "key", "left")
        .join(classes, "key", "left")
        .select("set_a", "set_b", F.coalesce("least", "key").alias("least"), n_links.alias("n_links"))
    )
    name = id_field.name
    found = rows.select("key", name, "set_a", "set_b").join(saved(known, "known"), ["set_a", "set_b"])
    found = saved(found.select("key", name, "least", "n_links"), "found")
    order = F.struct(F.col(name).isNull(), F.col(name), F.col("key"))
    first = F.min_by(F.struct(F.col(name).alias("id"), F.col("key").alias("key")), order)
    firsts = found.groupBy("least").agg(first.alias("f"))
    return found, saved(firsts.select("least", F.col("f.id").alias("class_id"), F.col("f.key").alias("first")), "firsts")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """One row per document: id, ``class_id``, ``n_links`` (other documents it is alike) and ``kept`` (one per class)."""
    found, firsts = _classes(to_blocks(docs, id_col, text_col), field_of(docs, id_col), similarity, recall)
    kept = (F.col("key") == F.col("first")).alias("kept")
    return found.join(firsts, "least").select(id_col, "class_id", "n_links", kept)


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """The first document of each class, with all columns."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    blocks = to_blocks(docs, id_col, text_col, others)
    _, firsts = _classes(blocks, field_of(docs, id_col), similarity, recall)
    places = firsts.groupBy(F.floor(F.col("first") / BLOCK_ROWS).alias("block")).agg(
        F.collect_list(F.col("first") % BLOCK_ROWS).alias("places")
    )
    schema = T.StructType([field_of(docs, c) for c in (id_col, text_col, *others)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, own in zip(batch.column(0), batch.column(1), strict=True):
                table = unpacked(rows.as_py()).take(pa.array(sorted(own.as_py()), pa.int64()))
                yield from table.combine_chunks().to_batches(max_chunksize=512)

    return blocks.join(places, "block").select("rows", "places").mapInArrow(run, schema).select(*docs.columns)
