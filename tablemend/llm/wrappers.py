"""Main text of web pages by inferred wrappers.

A page is read as a stream of block tags and text, nested by its tags. Within a page, runs of alike blocks fold into
repeated groups. Pages of one host are then aligned, one with the wrapper of those before: items that only one side
has become optional, neighbours that became alike become repeated, and text becomes a slot that remembers whether it
ever varied. The result is a regular expression without unions: tags, slots, ``( )?`` and ``( )+``. Wrappers of parts
of a host align with each other in the same way, so a host with any share of all pages is inferred in parts, first
per task, then in up to ``SPREAD`` groups, then once.

The wrapper tells which slots hold the article: those below its main element, or, where a host has none, those that
vary and are not mostly links; in either case outside menus, headers, footers, sidebars, notices, adverts, forms and
comments, which tags, roles and class names mark.

Rows: NULL or empty html gives empty text. A NULL or odd url belongs to the host ''. Repeated rows give a row each and
count as one page of evidence, as do pages whose texts outside menus are equal. An empty table gives no wrappers and no rows. Only id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_of, lean, saved, slices

#: groups that the parts of a host are aligned in before they meet
SPREAD = 16
#: wrappers are broadcast while all of them take at most this many bytes, else joined by host
BROADCAST_BYTES = 8 << 20
#: different pages from which a slot that never varied counts as template text
EVIDENCE = 4
#: items that a repeated group spans at most
GROUP = 6

# fixed values: element names by their role in a page
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script style noscript template textarea title iframe"
#: left out up to their end tag, or to the end of the block that holds them
_SKIPPED = frozenset(("svg", "object", "select"))
_ASIDE = frozenset("nav footer aside form button dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent gdpr alert "
    "popup modal overlay comment comments commentlist disqus respond reply replies discussion share sharing social "
    "related recommended newsletter subscribe signup login search widget toolbar pagination pager tags".split()
)
#: of these, the ones that name parts of an article as well: inside one they need evidence from the wrapper
_UNSURE = frozenset(
    "promo promotion side header notice notices alert comment reply replies respond discussion share sharing social related "
    "recommended search login signup tags menu navigation widget banner overlay consent".split()
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<[/!?A-Za-z][^<>]*+>?|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Block:
    """An element of a page, or of a wrapper; ``key`` '#' is a slot of text."""

    key: str
    optional: bool = False
    repeated: bool = False
    pages: int = 1
    seen: int = 0  # a hash of the slot's only text, -1 once it varied
    chars: int = 0
    linked: int = 0
    who: tuple[int, ...] = ()  # hashes of the texts of different pages that had it, EVIDENCE at most
    children: list[Block] = field(default_factory=list)
    text: str = ""

    def packed(self) -> list:
        """Blocks in order, each with the number of its children, so that no depth is too much."""
        out, left = [], [self]
        while left:
            b = left.pop()
            out.append([b.key, int(b.optional), int(b.repeated), b.pages, b.seen, b.chars, b.linked, b.who, len(b.children)])
            left += b.children[::-1]
        return out

    @staticmethod
    def unpacked(rows: list) -> Block:
        top: list[Block] = []
        open_blocks, deepest = [(top, 1)], 1
        for row in rows:
            block = Block(row[0], bool(row[1]), bool(row[2]), *row[3:7], tuple(row[7]))
            while not open_blocks[-1][1]:
                open_blocks.pop()
            into, n = open_blocks[-1]
            into.append(block)
            open_blocks[-1] = (into, n - 1)
            open_blocks.append((block.children, row[8]))
            deepest = max(deepest, len(open_blocks))
        _room(deepest)
        return top[0]


def _room(depth: int) -> None:
    """Lets blocks of this depth be walked: calls between Python functions take no other stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * depth + 1000))


def _below(path: bytes, key: str) -> bytes:
    """The path of a block as a hash, as long at any depth."""
    return hashlib.blake2b(path + key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _key(tag: str, rest: str) -> str:
    if "=" not in rest:
        return tag
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(rest)}
    marks = [f"{name}={re.sub(r'[0-9]+', '9', ' '.join(sorted(value.split())))}" for name, value in sorted(found.items()) if value]
    return " ".join([tag, *marks])


def page(source: str | None) -> Block:
    """The blocks and texts of one page."""
    root = Block("")
    open_blocks, text, linked, in_link = [root], [], 0, False
    skipped, inside = "", Counter()
    names: Counter[str] = Counter()
    deepest = 1

    def flush() -> None:
        nonlocal linked, in_link
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                open_blocks[-1].children.append(
                    Block("#", seen=zlib.crc32(joined.encode("utf-8", "surrogatepass")) or 1, chars=len(joined), linked=min(linked, len(joined)), text=joined)
                )
        linked, in_link = 0, False

    def close(tag: str, within: frozenset[str] = frozenset()) -> None:
        if not names[tag]:
            return
        for at in range(len(open_blocks) - 1, 0, -1):
            name = open_blocks[at].key.split(" ", 1)[0]
            if name == tag:
                names.subtract(b.key.split(" ", 1)[0] for b in open_blocks[at:])
                del open_blocks[at:]
                return
            if name in within:
                return

    for token in _TOKEN.finditer(source or ""):
        if skipped:
            name = (token["tag"] or "").lower()
            if not name:
                continue
            if not token["end"]:
                if name not in _VOID and not token["rest"].endswith("/"):
                    inside[name] += 1
                continue
            if inside[name]:
                inside[name] -= 1
                continue
            if name != skipped and not names[name]:
                continue
            done, skipped = name == skipped, ""
            if done:
                continue
        if token["text"] is not None:
            piece = references.unescape(token["text"]) if "&" in token["text"] else token["text"]
            text.append(piece)
            linked += len(piece) if in_link else 0
            continue
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag in _SKIPPED:
            if not token["end"] and (tag == "select" or not token["rest"].endswith("/")):
                skipped = tag
                inside.clear()
        elif tag == "br":
            text.append(" ")
        elif tag in _INLINE:
            if tag == "a":
                in_link = not token["end"]
        elif token["end"]:
            flush()
            close(tag)
        else:
            flush()
            if tag in _VOID:
                continue
            close("p", frozenset(("td", "th", "li", "blockquote", "button")))
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(tag, frozenset(("ul", "ol", "dl", "table", "tbody")))
            block = Block(_key(tag, token["rest"]))
            open_blocks[-1].children.append(block)
            open_blocks.append(block)
            names[tag] += 1
            deepest = max(deepest, len(open_blocks))
    flush()
    _room(deepest)
    _signed(root)
    return root


def _signed(root: Block) -> None:
    """Marks the blocks of a page with a hash of its text outside menus and their like: copies are one page."""
    blocks, left = [], [(root, False)]
    own = hashlib.blake2b(digest_size=8)
    while left:
        block, aside = left.pop()
        blocks.append(block)
        if block.key == "#":
            if not aside and 2 * block.linked <= block.chars:
                own.update(block.text.encode("utf-8", "surrogatepass") + b"\n")
        else:
            left += [(c, aside or (c.key != "#" and _aside(c, False))) for c in reversed(block.children)]
    who = (int.from_bytes(own.digest()[:7]),)
    for block in blocks:
        block.who = who


def _merge_slot(into: Block, other: Block) -> None:
    into.optional |= other.optional
    into.repeated |= other.repeated
    into.seen = into.seen if into.seen == other.seen else -1
    into.chars += other.chars
    into.linked += other.linked
    if into.who != other.who:
        into.who = tuple(sorted({*into.who, *other.who})[:EVIDENCE])


def _fold(items: list[Block]) -> list[Block]:
    """Neighbouring repeats of up to GROUP items become one repeated group; pages are not counted twice."""
    span = 1
    while span <= min(GROUP, len(items) // 2):
        out: list[Block] = []
        at, changed = 0, False
        while at < len(items):
            unit = [b.key for b in items[at : at + span]]
            following = items[at + span : at + 2 * span]
            if len(following) == span and unit == [b.key for b in following]:
                for first, again in zip(items[at : at + span], following, strict=True):
                    pages = max(first.pages, again.pages)
                    _join(first, again)
                    first.pages, first.repeated = pages, True
                items[at + span : at + 2 * span] = []
                changed = True
            else:
                out.append(items[at])
                at += 1
        items = out
        span = 1 if changed and span > 1 else span + 1
    return items


def _join(into: Block, other: Block) -> None:
    """Align another block of the same key with this one."""
    _merge_slot(into, other)
    into.pages += other.pages
    if into.children or other.children:
        into.children = align(into.children, other.children)


def align(left: list[Block], right: list[Block]) -> list[Block]:
    """The longest common subsequence of both item lists is joined, the rest becomes optional."""
    if [b.key for b in left] == [b.key for b in right]:
        for a, b in zip(left, right, strict=True):
            _join(a, b)
        return left
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i].key == right[j].key else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i].key == right[j].key:
            _join(left[i], right[j])
            out.append(left[i])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            left[i].optional = True
            out.append(left[i])
            i += 1
        else:
            right[j].optional = True
            out.append(right[j])
            j += 1
    return _fold(out)


def folded(block: Block) -> Block:
    """A page as a wrapper of itself."""
    block.children = _fold([folded(c) for c in block.children])
    return block


def expression(block: Block) -> str:
    """The wrapper as a regular expression without unions."""
    inner = "".join(expression(c) for c in block.children)
    body = "#" if block.key == "#" else f"<{block.key}>{inner}</>" if block.key else inner
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[block.optional, block.repeated]
    return f"({body}){mark}" if mark else body


def _told(block: Block) -> bool:
    """Whether the pages show that a block is no part of an article: template text, mostly links or a form."""
    chars = linked = 0
    template, left = True, [block]
    while left:
        for child in left.pop().children:
            if child.key == "#":
                chars, linked = chars + child.chars, linked + child.linked
                template &= child.seen >= 0 and not child.repeated and len(child.who) >= EVIDENCE
            elif child.key.split(" ", 1)[0] in ("form", "fieldset", "button"):
                return True
            else:
                left.append(child)
    return template or 2 * linked > chars


def _aside(block: Block, in_main: bool) -> bool:
    """Whether an element is no part of an article.

    Elsewhere any word of a class or id is a hint; inside an article only whole names are, and unsure ones by evidence.
    """
    name, _, marks = block.key.partition(" ")
    if name in _ASIDE or (name in ("header", "fieldset") and not in_main):
        return True
    for mark in re.split(r" (?=class=|id=|role=)", marks):
        kind, _, value = mark.partition("=")
        if kind == "role" and value in _ROLES:
            return True
        if kind in ("class", "id") and not name == "body" and not name == "html":
            if in_main:
                hints = _HINTS.intersection(value.split())
                if hints - _UNSURE or (hints and _told(block)):
                    return True
            elif any(word in _HINTS for word in re.split(r"[^a-z]+", value)):
                return True
    return False


def _is_main(key: str) -> bool:
    return key.split(" ", 1)[0] in ("article", "main") or "role=main" in key or "role=article" in key


def slots_of(wrapper: Block) -> dict[str, list[bytes]]:
    """Paths of the slots that hold the article: below main elements, and elsewhere."""
    found: dict[tuple[bool, bytes], list[bool]] = {}

    def walk(block: Block, path: bytes, in_main: bool) -> None:
        for child in block.children:
            if child.key == "#":
                varies = child.seen < 0 or child.repeated or len(child.who) < EVIDENCE
                mostly_links = 2 * child.linked > child.chars
                found.setdefault((in_main, path), []).append(in_main or (varies and not mostly_links))
            elif not _aside(child, in_main):
                walk(child, _below(path, child.key), in_main or _is_main(child.key))

    walk(wrapper, b"", False)
    return {
        "main": sorted(p for (inside, p), kept in found.items() if inside and any(kept)),
        "rest": sorted(p for (inside, p), kept in found.items() if not inside and any(kept)),
    }


def extract(source: str | None, known: dict[str, frozenset[bytes]]) -> str:
    """Main text of a page by the slots of its host's wrapper."""
    taken: dict[str, list[str]] = {"main": [], "rest": []}

    def walk(block: Block, path: bytes) -> None:
        for child in block.children:
            if child.key == "#":
                for place in ("main", "rest"):
                    if path in known[place]:
                        taken[place].append(child.text)
            else:
                walk(child, _below(path, child.key))

    walk(page(source), b"")
    return " ".join(taken["main"] or taken["rest"])


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


WRAPPERS = "host string, wrapper string"


def _load(text: str) -> Block:
    return Block.unpacked(json.loads(text))


def _one(parts: pd.DataFrame) -> str:
    whole: Block | None = None
    for text in parts["wrapper"]:
        part = _load(text)
        if whole is None:
            whole = part
        else:
            _join(whole, part)
    return json.dumps(whole.packed(), separators=(",", ":"))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One wrapper per host, from all of its pages."""

    @lean
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Block] = {}

        def told() -> pa.RecordBatch:
            rows = [json.dumps(w.packed(), separators=(",", ":")) for w in known.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(rows, pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                own = folded(page(source.as_py()))
                host = host.as_py()
                if host in known:
                    _join(known[host], own)
                else:
                    known[host] = own
            if len(known) > 10_000:  # many hosts in one task: their wrappers meet later
                yield told()
                known.clear()
        if known:
            yield told()

    def merge_in_part(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [parts["host"].iloc[0]], "wrapper": [_one(parts)]})

    parts = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(of_task, WRAPPERS)
    few = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(SPREAD))).groupBy("host", "part").applyInPandas(
        merge_in_part, WRAPPERS
    )
    return few.groupBy("host").applyInPandas(merge_in_part, WRAPPERS)


def main_text(
    pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: id, url and ``text``."""
    schema = T.StructType([field_of(pages, id_col), field_of(pages, url_col), T.StructField("text", T.StringType())])
    rows = pages.select(id_col, url_col, F.col(html_col).alias("__html"), _host(url_col).alias("__host"))
    known = wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    size = known.agg(F.sum(F.octet_length("__wrapper"))).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "__host", "left")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, dict[str, frozenset[bytes]]] = {}
        for batch in batches:
            sources, plans = batch.column(2), batch.column(3)
            for start, end in slices(batch, (len(s.as_py() or "") for s in sources)):
                texts = []
                for source, plan in zip(sources.slice(start, end - start), plans.slice(start, end - start), strict=True):
                    key = plan.as_py() or '[["",0,0,1,0,0,0,[],0]]'
                    if key not in cache:
                        if len(cache) > 1000:
                            cache.clear()
                        cache[key] = {k: frozenset(v) for k, v in slots_of(_load(key)).items()}
                    texts.append(extract(source.as_py(), cache[key]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(start, end - start) for i in (0, 1)], pa.array(texts, pa.string())],
                    names=schema.names,
                )

    return joined.select(id_col, url_col, "__html", "__wrapper").mapInArrow(run, schema)


def extracted(pages: DataFrame) -> DataFrame:
    """Wrappers of all hosts, then the main text of all pages."""
    return main_text(pages, saved(infer(pages), "wrappers"))
