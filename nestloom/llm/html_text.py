"""Main text of web pages by host suffix arrays (operator 5).

A page is cut into blocks of text at block elements. Scripts, styles, forms, navigation and what is marked as an advert, a
notice or a comment never give text. Blocks inside an article or main element are the page's own, the others are open.

The streams of open words of a host's pages are joined, and their suffixes are sorted by their first RUN words through
doubling. Every window of RUN words that stands on two or more distinct pages is thus found, and the union of such windows
is exactly what the repeated substrings of at least RUN words cover. An open block with COVERED of its words in this cover
is boilerplate. Open blocks that are free of it are the text of a page without a block of its own, and join the own ones
where these are less than a RIVAL-th of the words left. An own block of RUN words or more that stands on at least HEAVY
distinct pages and on half of its host's is boilerplate too; other own blocks stay however often they are repeated, as
an article, or a passage of it, may stand on several pages.

A host's pages are dealt by hash to shards of about SHARD pages, so that no task holds a host of unbounded size. For hosts of
several shards the windows that stand on two or more distinct pages of the whole host are found by an aggregation of
(host, window hash), and each shard gets those that occur in it, so the cover doesn't depend on the dealing. A row that is
repeated more than SHARD times is cut once and given back as often as it was there.

White space is what Python's str.split takes for it, no-break spaces included. A null or empty html gives an empty text.
Pages without a host (null or odd address) form one host. Every row is returned, repeated ones too; copies of a page are
one page to the search, whatever their ids. A null id is an id like others. Only page_id, url and html are read, so other
columns can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, make_room, small_side, text_batches, text_or_empty, written
from .shingles import _word_hashes, constants, mix

RUN, COVERED, SHARD, RIVAL, HEAVY = 8, 0.7, 256, 3, 8

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)([\s/]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|</[^A-Za-z>][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
_PIECE = re.compile(r"[a-z0-9]+")

#: Element names of the markup language by what they do to the text.
RAW = frozenset("script style noscript template textarea iframe title noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form head menu dialog fieldset search".split())
SILENT = frozenset("svg select datalist button object audio video canvas annotation annotation-xml".split())
OWN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end the nearest open element of the first names, and what of the second names is inside it,
#: unless one of the last names is nearer.
IMPLIED = {k: tuple(frozenset(x.split()) for x in names) for k, *names in (("li", "li", "", "ul ol menu"), ("dt", "dt dd", "", "dl"), ("dd", "dt dd", "", "dl"), ("tr", "tr", "td th", "table"), ("td", "td th", "", "tr table"), ("th", "td th", "", "tr table"), ("tbody", "thead tbody tfoot caption", "tr td th", "table"), ("tfoot", "thead tbody tfoot caption", "tr td th", "table"), ("thead", "thead tbody tfoot caption", "tr td th", "table"))}
#: An end tag of another element than a part of a table doesn't reach past these.
SCOPES, TABLE = frozenset("table td th caption object".split()), frozenset("table tr tbody thead tfoot td th caption".split())
#: Words in class, id or role that mark what is not the page's own text; an article inside what the first
#: line's words mark is still one, as they also name layouts; the last line's words mark an article itself.
LAYOUT = frozenset("sidebar menu nav navbar navigation banner search toolbar hidden overlay social share sharing login signup widget footer masthead".split())
MARKS = LAYOUT | frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription breadcrumb breadcrumbs related recommended pagination pager comment comments disqus reply replies".split())
REMARKS = frozenset("comment comments reply replies related recommended ad advert sponsored promo".split())
#: Words that make a class tell about a page's layout or state instead of naming a part.
STATES = frozenset("has with no without is not open closed enabled disabled layout".split())
#: How firmly an element is left out: not at all; until an article or main inside it; until a main; with all inside it.
KEPT, SOFT, FIRM, GONE = range(4)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower())
    return found


def _marked(attributes: dict[str, str]) -> int:
    """How firmly an element's attributes leave it out."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return GONE
    out = KEPT
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").split():
            pieces = set(_PIECE.findall(token))
            if pieces & MARKS and not pieces & STATES:
                out = max(out, FIRM if pieces & MARKS - LAYOUT else SOFT)
    return out


def _is_own(attributes: dict[str, str]) -> bool:
    return attributes.get("role") == "main" or "articlebody" in attributes.get("itemprop", "").split()


def page_blocks(page: str) -> list[tuple[str, bool]]:
    """text and whether it is inside an article, of each block in page order that may be text."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int, bool, int]] = []  # name, own, how firmly left out, whether it is a block, scope
    own, gone, scope = False, KEPT, 0
    inline: dict[str, int] = {}  # names of open inline elements that are left out
    opened: dict[tuple[int, str], int] = {}  # open blocks by scope and name; parts of tables as if in one scope
    text: list[str] = []
    pos = 0

    def flush() -> None:
        if text:
            words = "".join(text).split()
            text.clear()
            if words:
                out.append((" ".join(words), own))

    def pop(to: int) -> None:
        nonlocal own, gone, scope
        if any(s[3] for s in stack[to:]):
            flush()
        for name, _, _, block, at in stack[to:]:
            if block:
                opened[(0 if name in TABLE else at, name)] -= 1
            else:
                inline[name] -= 1
            scope -= block and name in SCOPES
        del stack[to:]
        own, gone = (stack[-1][1], stack[-1][2]) if stack else (False, KEPT)

    def push(name: str, is_own: bool, firmly: int, block: bool) -> None:
        nonlocal own, gone, scope
        stack.append((name, is_own, firmly, block, scope))
        if block:
            key = (0 if name in TABLE else scope, name)
            opened[key] = opened.get(key, 0) + 1
        else:
            inline[name] = inline.get(name, 0) + 1
        scope += block and name in SCOPES
        own, gone = is_own, firmly

    def is_open(name: str) -> bool:
        return bool(opened.get((0 if name in TABLE else scope, name)))

    while (m := _TOKEN.search(page, pos)) is not None:
        if m.start() > pos and not gone:
            text.append(html.unescape(page[pos : m.start()]))
        pos = m.end()
        if m[2] is None:
            continue
        name, closed = m[2].lower(), "/" in m[4]
        if name in RAW:
            if not m[1] and not closed:
                # What a template holds may hold templates; the others end at their first end tag.
                deep = 1
                while deep:
                    tag = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                    pos = tag.end() if tag else len(page)
                    deep = 0 if not tag else deep - 1 if tag[1] else deep + (name == "template")
            continue
        if name in VOID:
            if name in ("br", "hr") and not gone:
                text.append(" ") if name == "br" else flush()
            continue
        if name not in BLOCKS:
            if m[1]:
                if inline.get(name):
                    pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name and not stack[i][3]))
            elif not closed:
                firmly = GONE if name in SILENT else max(gone, _marked(_attributes(m[3]))) if m[3].strip() else gone
                if firmly > gone or inline.get(name):
                    push(name, own, max(gone, firmly), False)
            continue
        if m[1]:
            if is_open(name):
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][3] and stack[i][0] == name))
            flush()
            continue
        flush()
        if name in IMPLIED and any(map(is_open, IMPLIED[name][0] | IMPLIED[name][1])):
            nearest, inside, until = IMPLIED[name]
            to = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in until:
                    break
                if stack[i][0] in nearest | inside:
                    to = i
                if stack[i][0] in nearest:
                    break
            if to is not None:
                pop(to)
        for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
            if stack[i][0] == "p":
                pop(i)
                break
            if stack[i][3]:
                break
        if closed:
            continue
        found = _attributes(m[3]) if m[3].strip() else {}
        marked = _marked(found) if found and name not in ("html", "body") else KEPT
        if name in OWN:
            classes = set(found.get("class", "").split()) | {found.get("id", "")}
            firmly = KEPT if gone <= SOFT or name == "main" and gone == FIRM else gone
            firmly = GONE if marked == GONE or name == "article" and classes & REMARKS else firmly
        else:
            firmly = max(gone, marked, (SOFT if name in ("form", "fieldset") else GONE) if name in NEVER else KEPT)
            if name == "header" and not own:
                firmly = max(firmly, SOFT)
        push(name, own or not firmly and (name in OWN or _is_own(found)), firmly, True)
    if not gone:
        text.append(html.unescape(page[pos:]))
    flush()
    return out


def covered_words(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """For each page's stream of word hashes: which words lie in a run of that many words that is on another page too."""
    size = [len(s) for s in streams]
    total = sum(size)
    if not total:
        return [np.zeros(n, dtype=bool) for n in size]
    page = np.repeat(np.arange(len(streams)), size)
    end = np.repeat(np.cumsum(size), size)
    _, rank = np.unique(np.concatenate(streams), return_inverse=True)
    rank, width, at = rank.astype(np.int64), 1, np.arange(total)
    while width < run:  # ranks of prefixes of double width; those that the page's end cuts off stay apart
        ahead = np.minimum(width, run - width)
        nxt = at + ahead
        second = np.where(nxt < end, rank[np.minimum(nxt, total - 1)], -1 - page)
        _, rank = np.unique(rank * (total + len(streams) + 2) + second + len(streams) + 1, return_inverse=True)
        width += ahead
    order = np.argsort(rank, kind="stable")  # the suffixes in order of their first `run` words
    first = np.flatnonzero(np.diff(rank[order], prepend=-1))
    pages = page[order]
    repeated = np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first)
    hit = np.zeros(total, dtype=bool)
    hit[order] = np.repeat(repeated, np.diff(np.append(first, total)))
    hit &= at + run <= end
    depth = np.zeros(total + 1, dtype=np.int64)
    depth[:-1] += hit
    np.subtract.at(depth, at[hit] + run, 1)
    return np.split(np.cumsum(depth[:-1]) > 0, np.cumsum(size)[:-1])


def _windows(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of each window of that many words."""
    n = len(words) - run + 1
    if n < 1:
        return np.empty(0, np.uint64)
    factor = constants(run, 6)
    return mix(sum((words[j : n + j] * factor[j] for j in range(run)), np.zeros(n, np.uint64)))


def _spread(hit: np.ndarray, size: int, run: int = RUN) -> np.ndarray:
    """Which of the words lie in a window that is hit."""
    depth = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    depth[at] += 1
    depth[at + run] -= 1
    return np.cumsum(depth[:-1]) > 0


def _words(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all blocks, and each block's number of words."""
    data = np.frombuffer("\n".join(blocks).encode("utf-8", "surrogatepass"), np.uint8)
    return _word_hashes(data)[1], np.array([b.count(" ") + 1 for b in blocks], dtype=np.int64)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def chosen(blocks: list[tuple[str, bool]], covered: np.ndarray, heavy: set[int]) -> list[str]:
    """The texts of a page. covered: of the words of its open blocks, one after the other."""
    left, own_words, open_words, at = [], 0, 0, 0
    for text, own in blocks:
        n = text.count(" ") + 1
        if own:
            if not heavy or n < RUN or _number(text) not in heavy:
                left.append((text, True))
                own_words += n
        else:
            if covered[at : at + n].sum() < COVERED * n:
                left.append((text, False))
                open_words += n
            at += n
    if own_words and RIVAL * own_words >= own_words + open_words:
        return [t for t, own in left if own]
    return [t for t, _ in left]


def _hosts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, html, copies: a row for each page, and one for all copies of a row that has more than SHARD."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    named = pages.select("page_id", "url", host.alias("host"), text_or_empty("html").alias("html"))
    row = F.xxhash64("page_id", F.coalesce("url", F.lit("")), "html", F.lit(3))
    hot = written(named.groupBy(row.alias("row_")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("row_"), "hot_pages")
    if hot.isEmpty():
        return named.withColumn("copies", F.lit(1).cast("bigint"))
    marked = named.withColumn("row_", row)
    once = marked.join(small_side(hot), "row_", "left_semi").groupBy("page_id", "url", "host", "html").agg(F.count(F.lit(1)).alias("copies"))
    return marked.join(small_side(hot), "row_", "left_anti").drop("row_").withColumn("copies", F.lit(1).cast("bigint")).unionByName(once)


def extract_text(pages: DataFrame) -> DataFrame:
    """For each row: page_id, url, text, n_chars."""
    text_batches(pages.sparkSession)
    id_type = pages.schema["page_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = [page_blocks(t) for t in part.column(4).to_pylist()]
                packed = [pack.compress("\n".join(b for b, _ in r).encode()) for r in rows]
                flags = [bytes(own for _, own in r) for r in rows]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], part.column(5), pa.array(packed, pa.binary()), pa.array(flags, pa.binary())], names=["page_id", "url", "host", "copies", "shard", "packed", "flags"])
                give_back(part.nbytes)

    def cut_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                got = []
                for key, shard, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    blocks = page_blocks(text)
                    texts = [b for b, own in blocks if not own]
                    if texts and len(w := np.unique(_windows(_words(texts)[0]).view(np.int64))):
                        got.append((np.full(len(w), key), np.full(len(w), shard), w, np.full(len(w), _number("\n".join(b for b, _ in blocks)))))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*got, strict=True)], names=["key", "shard", "window", "page"])

    def cut_own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, block, page: of each own block of RUN words or more, and a row without a block for each page."""
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out: list[tuple[int, int | None, int]] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    blocks = page_blocks(text)
                    page = _number("\n".join(b for b, _ in blocks))
                    out.append((key, None, page))
                    out += [(key, i, page) for i in {_number(b) for b, own in blocks if own and b.count(" ") + 1 >= RUN}]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "block", "page"])

    named = _hosts(pages)
    key = F.xxhash64("host")
    counts = written(named.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY), "hosts")
    shards = written(counts.where(F.col("n") > SHARD).select("host", F.ceil(F.col("n") / SHARD).cast("bigint").alias("shards")), "shards")
    shard = F.pmod(F.xxhash64("page_id", "html", F.lit(5)), F.coalesce("shards", F.lit(1).cast("bigint")))
    dealt = named.join(small_side(shards), "host", "left").select("page_id", "url", "host", "copies", "html", shard.alias("shard"))
    blocks = dealt.mapInArrow(cut, f"page_id {id_type}, url string, host string, copies bigint, shard bigint, packed binary, flags binary")

    # Own blocks on half of a host's distinct pages: at most about twice as many as a page has.
    of_host = named.join(small_side(counts), "host", "left_semi").select(key.alias("key"), "html").mapInArrow(cut_own, "key bigint, block bigint, page bigint")
    seen = of_host.distinct().groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    seen = written(seen.where(F.col("block").isNull() | (F.col("n") >= HEAVY)), "own_blocks")
    heavy = seen.where("block is not null").join(seen.where("block is null").select("key", F.col("n").alias("pages")), "key").where("2 * n >= pages").groupBy("key").agg(F.collect_list("block").alias("heavy"))

    # Copies of a page have one number, so they don't make a window repeated.
    large = named.join(small_side(shards), "host").select(key.alias("key"), shard.alias("shard"), "html")
    windows = large.mapInArrow(cut_windows, "key bigint, shard bigint, window bigint, page bigint")
    repeated = windows.groupBy("key", "window").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.collect_set("shard").alias("shard")).where("a < b")
    per_shard = repeated.select("key", F.explode("shard").alias("shard"), "window").groupBy("key", "shard").agg(F.collect_list("window").alias("windows"))
    every = counts.join(small_side(shards), "host", "left").select("host", key.alias("key"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shards", F.lit(1).cast("bigint")) - 1)).alias("shard"))
    fed = every.join(per_shard, ["key", "shard"], "left").join(heavy, "key", "left").where("windows is not null or heavy is not null").select("host", "shard", "windows", "heavy")

    def search(rows: pa.Table, whole: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        texts = [unpack.decompress(p).decode() for p in rows["packed"].to_pylist()]
        pages = [list(zip(t.split("\n"), map(bool, f), strict=True)) if f else [] for t, f in zip(texts, rows["flags"].to_pylist(), strict=True)]
        distinct: dict[str, int] = {}
        number = [distinct.setdefault(t, len(distinct)) for t in texts]
        some: list[list[tuple[str, bool]]] = [[] for _ in distinct]
        for i, p in zip(number, pages, strict=True):
            some[i] = p
        words = [_words(o)[0] if (o := [b for b, own in p if not own]) else np.empty(0, np.uint64) for p in some]
        cover = covered_words(words)
        heavy: set[int] = set()
        for windows, blocks in zip(whole["windows"].to_pylist(), whole["heavy"].to_pylist(), strict=True):
            heavy |= set(blocks or ())
            if windows:
                known = np.asarray(windows, dtype=np.int64)
                cover = [c | _spread(np.isin(_windows(w).view(np.int64), known), len(w)) for c, w in zip(cover, words, strict=True)]
        made = ["\n".join(chosen(p, cover[i], heavy)) for i, p in zip(number, pages, strict=True)]
        give_back(sum(map(len, made)))
        return pa.table({"page_id": rows["page_id"], "url": rows["url"], "text": pa.array(made, pa.string()), "n_chars": pa.array(map(len, made), pa.int64()), "copies": rows["copies"]})

    found = blocks.groupBy("host", "shard").cogroup(written(fed, "fed").groupBy("host", "shard")).applyInArrow(search, f"page_id {id_type}, url string, text string, n_chars bigint, copies bigint")
    return found.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("page_id", "url", "text", "n_chars")
