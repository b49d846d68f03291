"""Main text of web pages: marked furniture goes by structure, unmarked by a host suffix array.

A page is read as blocks of text. Blocks inside marked furniture (menus, forms,
comments, ...) go at once. The tokens of the others form the page's stream. The
streams of a host's pages are put together and their suffixes ordered by
doubling, which names every substring of a given length: substrings with a
common prefix that long have one name. A *unit* is the shortest sequence of
whole blocks, from a block on, with ``RUN`` tokens or more. A unit that stands on
most of the host's different articles is boilerplate, and its blocks go; text
that one block repeats from another never cuts a block in two.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.words import hashed_words, mix, powers
from nightframe.session import cut_lineage

#: Shortest repeated substring in tokens.
RUN = 8
#: Boilerplate stands on this share of a host's different articles, and on so many at least.
SHARE = 0.5
ARTICLES = 4
#: Pages with fewer different articles are too few to rule a unit out before all are counted.
FEW = 16
#: Pages and characters of html whose suffixes are ordered together.
CHUNK_PAGES = 4096
CHUNK_CHARS = 32_000_000
#: Units (8 bytes) that may be broadcast; more are shuffled.
BROADCAST_UNITS = 1_000_000

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
RAW = set("script style textarea title noscript iframe template svg math object canvas audio video".split())
DROPPED = set(
    "head nav footer aside form button select dialog menu option fieldset script style textarea title noscript iframe "
    "template svg math object canvas audio video".split()
)
MAIN = {"article", "main"}
#: Words of a class or id that mark furniture, and roles that do.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget "
    "widgets related recommended recommendations share sharing social comment comments commentlist reply replies disqus "
    "breadcrumb breadcrumbs menu navbar nav navigation footer masthead toolbar pagination pager search".split()
)
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "alert", "dialog", "alertdialog", "form", "menu"}
KEPT_TAGS = {"html", "body", "article", "main"}

_MARKUP = re.compile(r"<(?:(?P<note>!--)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)|[!?])")
_QUOTES = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Elements that a start tag of the key closes while they are open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}


def _is_furniture(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_main):
        return True
    if not attrs or name in KEPT_TAGS:
        return False
    words = set(_SPLIT.split(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    return bool(
        words & MARKS or attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden", "").lower() == "true"
        or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I)
    )


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: ``text``, ``start``, ``end``, ``raw`` or ``gap``.

    Every character is looked at a bounded number of times. A tag without an end
    is text; if its quotes swallow the end of the page, quotes count no more.
    """
    at, look, last, quotes = 0, 0, page.rfind(">"), True
    while m := _MARKUP.search(page, look):
        if m["note"]:
            close = page.find("-->", m.end())
            stop = len(page) if close < 0 else close + 3
        elif m.end() > last:
            break  # no tag ends any more
        else:
            stop, pos = -1, m.end()
            while quotes and m["name"] and stop < 0:
                q = _QUOTES.search(page, pos)
                close = -1 if q is None else q.start() if q[0] == ">" else page.find(q[0], q.end())
                if close < 0:
                    quotes = False
                elif q[0] == ">":
                    stop = close + 1
                else:
                    pos = close + 1
            if stop < 0:
                stop = page.find(">", m.end()) + 1
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = look = stop
        name = (m["name"] or "").lower()
        if not name:
            yield "gap", "", ""
            continue
        attrs = page[m.end() : stop - 1]
        if name in RAW and not m["end"]:
            close = _RAW_END[name].search(page, stop)
            at = look = len(page) if close is None else close.end()
            yield "raw", name, attrs
        else:
            yield "end" if m["end"] else "start", name, attrs
    if at < len(page):
        yield "text", page[at:], ""


def page_blocks(page: str) -> list[str]:
    """Texts of a page's blocks in order, without marked furniture.

    Markup may be broken: a tag that is never closed ends with its parent, and
    an article inside furniture that was left open ends the furniture. The time
    taken grows with the length of the page alone.
    """
    blocks: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, main
    names: Counter[str] = Counter()  # of the stack
    count = {"furniture": 0, "main": 0, "comments": 0}
    parts: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(text)

    def push(name, furniture, main):
        stack.append((name, furniture, main))
        names[name] += 1
        count["furniture"] += furniture
        count["main"] += main
        count["comments"] += furniture and _is_comments(name)

    def pop():
        name, furniture, main = stack.pop()
        names[name] -= 1
        count["furniture"] -= furniture
        count["main"] -= main
        count["comments"] -= furniture and _is_comments(name)
        return name

    for kind, name, attrs in _tokens(page):
        if kind == "text":
            if not count["furniture"]:
                parts.append(name)
            continue
        if kind in ("raw", "gap"):
            continue
        if name == "br" and not count["furniture"]:
            parts.append(" ")
        if name not in INLINE:
            flush()
        if kind == "end":
            while names[name] and pop() != name:
                pass
            continue
        if name in CLOSES:
            while stack and stack[-1][0] in CLOSES[name]:
                pop()
        if name in VOID or attrs.endswith("/"):
            continue
        found = _attributes(attrs)
        main = name in MAIN or found.get("role", "").lower() == "main"
        in_main = count["main"] > 0
        if main and not in_main and count["furniture"] > count["comments"]:
            # Furniture that is open here was not closed; comments set as articles stay furniture.
            stack[:] = [(n, f and _is_comments(n), m) for n, f, m in stack]
            count["furniture"] = count["comments"]
        furniture = _is_furniture(name, found, in_main)
        if furniture and re.search("comment|repl", attrs, re.I):
            push(name, False, False)  # found by its end tag
            push("comments", True, main)
        else:
            push(name, furniture, main)
    flush()
    return blocks


def _is_comments(name: str) -> bool:
    return "comment" in name or "repl" in name


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0]


def host_key(host: str) -> int:
    return int.from_bytes(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_units(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block, block after the last) of each unit; ``edges`` are the blocks' borders in tokens."""
    after = np.searchsorted(edges, edges[:-1] + RUN)
    first = np.flatnonzero(after < len(edges))
    return first, after[first]


def name_substrings(stream: np.ndarray, ends: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of substrings of a token stream by ordering its suffixes, and of all runs of ``RUN`` tokens.

    ``ends`` has, for every token, the end of its page. Suffixes are ordered by
    their first 1, 2, 4, ... tokens; two are named alike at a length if they
    agree so far. A substring is named by those of its two longest parts of
    such a length. -1: it occurs once, or the page ends before.
    """
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    names, runs = np.full(len(starts), -1, np.int64), np.full(n, -1, np.int64)
    length, known = 1, 0
    place = np.arange(n)
    while True:
        due = np.flatnonzero((lengths >= length) & (lengths < 2 * length))
        if len(due):
            a, b = rank[starts[due]], rank[starts[due] + lengths[due] - length]
            whole = (a >= 0) & (b >= 0)
            pair = np.stack([lengths[due][whole], a[whole], b[whole]])
            names[due[whole]] = known + np.unique(pair, axis=1, return_inverse=True)[1].ravel()
            known += len(due)
        if length == RUN:
            runs = rank
        if length >= RUN and 2 * length > lengths.max(initial=0):
            return names, runs
        inside = np.flatnonzero((rank >= 0) & (place + 2 * length <= ends))
        inside = inside[rank[inside + length] >= 0]
        longer = np.full(n, -1, np.int64)
        _, back, times = np.unique(rank[inside] * n + rank[inside + length], return_inverse=True, return_counts=True)
        longer[inside] = np.where(times[back] > 1, back, -1)
        rank, length = longer, 2 * length


def _per_page(names: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (name, page) pairs of named substrings."""
    found = np.unique(np.stack([names, pages])[:, names >= 0], axis=1)
    return found[0], found[1]


def host_repeats(pages: list[list[str]]) -> tuple[list[dict], list[int]]:
    """The units of a host's pages, which of them most of these pages repeat, and each page's number of copies.

    A page's copies are the pages that its middle run is found on, its runs
    ordered by that number.
    """
    texts = ["\n".join(blocks) for blocks in pages]
    owner, stream = hashed_words(texts, lower=False)
    sizes = np.bincount(owner, minlength=len(pages)) if len(owner) else np.zeros(len(pages), np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    firsts, afters, starts, lengths = [], [], [], []
    for k, blocks in enumerate(pages):
        edges = np.cumsum([0, *[b.count(" ") + 1 for b in blocks]])
        first, after = page_units(edges)
        firsts.append(first)
        afters.append(after)
        starts.append(begins[k] + edges[first])
        lengths.append(edges[after] - edges[first])
    start, length = np.concatenate(starts), np.concatenate(lengths)
    page = np.repeat(np.arange(len(pages)), [len(f) for f in firsts])
    if not len(start):
        empty = {"unit": [], "first": [], "after": [], "runs": [], "often": []}
        return [dict(empty) for _ in pages], [1] * len(pages)
    names, runs = name_substrings(stream, np.repeat(begins[1:], sizes), start, length)
    copies = np.ones(len(pages))
    of_run, on = _per_page(runs, owner)
    held = np.bincount(of_run, minlength=1)
    at = np.flatnonzero(runs >= 0)
    order = np.lexsort((-held[runs[at]], owner[at]))
    counts, by_page = held[runs[at]][order], owner[at][order]
    n_runs = np.maximum(sizes - RUN + 1, 0)
    middle = np.searchsorted(by_page, np.arange(len(pages))) + n_runs // 2
    has = (np.bincount(by_page, minlength=len(pages)) > n_runs // 2) & (n_runs > 0)
    copies[has] = counts[middle[has]]
    different = (1 / copies).sum()
    of_unit, on = _per_page(names, page)
    weight = np.bincount(of_unit, weights=1 / copies[on], minlength=1)
    often = np.where(names >= 0, weight[names], 1 / copies[page]) >= SHARE * different - 1e-6
    often |= different < FEW
    # The same unit has the same value on every page: its tokens, shifted to its start.
    power = powers(len(stream) + 1)
    inverse = powers(len(stream) + 1, np.uint64(pow(int(power[1]), -1, 2**64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(stream * power[:-1], dtype=np.uint64)])
    value = mix((total[start + length] - total[start]) * inverse[start] + length.astype(np.uint64)).view(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in firsts])])
    found = [
        {"unit": value[a:b], "first": firsts[k], "after": afters[k], "runs": length[a:b] - RUN + 1, "often": often[a:b]}
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))
    ]
    return found, np.round(copies).astype(int).tolist()


PARSED = (
    "page_id bigint, url string, host bigint, blocks array<string>, unit array<bigint>, first array<int>, after array<int>, "
    "runs array<int>, often array<boolean>, n_runs int, copies int"
)
_LISTS = {"unit": pa.int64(), "first": pa.int32(), "after": pa.int32(), "runs": pa.int32(), "often": pa.bool_()}


def _chunk(ids: list, urls: list, html: list) -> pa.RecordBatch:
    blocks = [page_blocks(h or "") for h in html]
    hosts = [host_of(u) for u in urls]
    units: list[dict] = [{}] * len(ids)
    copies = [1] * len(ids)
    members: dict[str, list[int]] = {}
    for k, host in enumerate(hosts):
        members.setdefault(host, []).append(k)
    for mine in members.values():
        for k, found, n in zip(mine, *host_repeats([blocks[k] for k in mine])):
            units[k], copies[k] = found, n
    n_runs = [max(sum(b.count(" ") + 1 for b in own) - RUN + 1, 0) for own in blocks]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([host_key(h) for h in hosts], pa.int64()), pa.array(blocks, pa.list_(pa.string())),
         *[pa.array([u[name] for u in units], pa.list_(kind)) for name, kind in _LISTS.items()],
         pa.array(n_runs, pa.int32()), pa.array(copies, pa.int32())],
        names=["page_id", "url", "host", "blocks", *_LISTS, "n_runs", "copies"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) to ``PARSED``; the pages of a host in a chunk of rows are compared."""
    ids, urls, html, chars = [], [], [], 0
    for batch in batches:
        for i, u, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if ids and (len(ids) == CHUNK_PAGES or chars + len(h or "") > CHUNK_CHARS):
                yield _chunk(ids, urls, html)
                ids, urls, html, chars = [], [], [], 0
            ids.append(i)
            urls.append(u)
            html.append(h)
            chars += len(h or "")
    if ids:
        yield _chunk(ids, urls, html)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, blocks, gone) to (page_id, url, text): blocks inside a span of ``gone`` go."""
    for batch in batches:
        texts = []
        for blocks, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            dropped = {k for span in gone or () for k in range(span["first"], span["after"])}
            texts.append("\n".join(b for k, b in enumerate(blocks) if k not in dropped))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _small(rows: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= limit else rows


def boilerplate_units(parsed: DataFrame) -> DataFrame | None:
    """(host, unit) of the units that stand on most of their host's different articles; None if there are none.

    A unit that does so over all of a host's pages does so in one of the chunks,
    or in one with few articles: only these are counted, as rows of 8 bytes.
    A page counts as one divided by its copies, those of its chunk or, counted
    over the units of all pages that hold a candidate, the pages that the middle
    one of its runs is found on.
    """
    each = parsed.select(
        "rid", "host", "copies", "n_runs", F.explode(F.arrays_zip("unit", "runs", "often")).alias("x")
    ).select("rid", "host", "copies", "n_runs", "x.*")
    flagged = cut_lineage(each.filter("often").select("host", "unit").distinct(), "flagged-units")
    if flagged.isEmpty():
        return None
    candidates = cut_lineage(
        each.select("rid", "host", "unit").join(_small(flagged, BROADCAST_UNITS), ["host", "unit"], "left_semi").distinct()
        .groupBy("host", "unit").agg(F.count("*").alias("n")).filter(F.col("n") >= ARTICLES).select("host", "unit"),
        "candidate-units",
    )
    if candidates.isEmpty():
        return None
    candidates = _small(candidates, BROADCAST_UNITS)
    holders = each.join(candidates, ["host", "unit"], "left_semi").select("rid").distinct()
    mine = cut_lineage(each.join(holders, "rid", "left_semi"), "units-of-holders")
    repeated = mine.groupBy("host", "unit").agg(F.count_distinct("rid").alias("n")).filter("n > 1")
    weighed = (
        mine.join(repeated, ["host", "unit"])
        .groupBy("rid", "host", "copies", "n_runs")
        .agg(F.sort_array(F.collect_list(F.struct("n", "runs")), asc=False).alias("x"))
    )
    upto = F.aggregate(
        "x", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(1).cast("bigint").alias("n")),
        lambda a, x: F.when(2 * a["sum"] > F.col("n_runs"), a).otherwise(
            F.struct((a["sum"] + x["runs"]).alias("sum"), F.when(2 * (a["sum"] + x["runs"]) > F.col("n_runs"), x["n"]).otherwise(F.lit(1)).cast("bigint").alias("n"))
        ),
    )["n"]
    weights = cut_lineage(weighed.select("rid", "host", F.greatest(upto, F.col("copies")).alias("copies")), "page-weights")
    articles = parsed.select("rid", "host", "copies").join(
        weights.select("rid", F.col("copies").alias("_more")), "rid", "left"
    ).groupBy("host").agg(F.sum(1 / F.coalesce("_more", "copies")).alias("articles"))
    found = (
        mine.select("rid", "host", "unit").join(candidates, ["host", "unit"], "left_semi").distinct()
        .join(weights.select("rid", "copies"), "rid")
        .groupBy("host", "unit").agg(F.sum(1 / F.col("copies")).alias("weight"))
    )
    wide = found.join(articles, "host").filter(
        (F.col("weight") > ARTICLES - 1e-6) & (F.col("weight") >= SHARE * F.col("articles") - 1e-6)
    )
    return cut_lineage(wide.select("host", "unit"), "boilerplate-units")


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every row of ``pages``; ``text`` is empty where there is none.

    A null html is an empty page, a null url the host ''. Repeated rows are pages
    of their own and copies of each other; an empty table gives an empty one.
    Other columns are not read. A page of which most is shared with the other
    pages of its host is a copy of them: all these count as one article.
    """
    source = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    parsed = cut_lineage(source.mapInArrow(_parse, PARSED).withColumn("rid", F.monotonically_increasing_id()), "page-blocks")
    wide = boilerplate_units(parsed)
    none = F.lit(None).cast("array<struct<first:int,after:int>>")
    if wide is None or wide.isEmpty():
        return parsed.select("page_id", "url", "blocks", none.alias("gone")).mapInArrow(_assemble, "page_id bigint, url string, text string")
    spans = (
        parsed.select("rid", "host", F.explode(F.arrays_zip("unit", "first", "after")).alias("x"))
        .select("rid", "host", "x.unit", "x.first", "x.after")
        .join(_small(wide, BROADCAST_UNITS), ["host", "unit"])
        .groupBy(F.col("rid").alias("_rid"))
        .agg(F.collect_list(F.struct("first", "after")).alias("gone"))
    )
    return (
        parsed.join(spans, F.col("rid") == F.col("_rid"), "left")
        .select("page_id", "url", "blocks", "gone")
        .mapInArrow(_assemble, "page_id bigint, url string, text string")
    )
