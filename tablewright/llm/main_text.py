"""Main text of web pages: host suffix arrays, with markup as evidence.

The token streams of all pages of a host are put one after the other and their suffixes sorted. Neighbours in that order
share prefixes, so runs of suffixes that have eight tokens or more in common are the repeated substrings; what repeats on
several different pages is evidence of boilerplate. Copies of a page count as one page.

* On a page without an article, repeated substrings go; runs that only one or two pages have stay.
* In an article or main element, which markup sets apart, text repeats for good reasons too: pages quote each other.
  There a block goes if most pages of its host show it as a whole, and what markup says is something else goes always.

A host's pages are dealt to groups of bounded size, so no host is too large for a task. Runs and blocks have names that
mean the same in every group: counts of pages are added up over groups before they decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table, written

RUN = 8  # tokens of the shortest repeated run, block ends included
PAGES = 3  # different pages that must share it
HOST_PAGES = 8  # different pages from which on most pages of a host tell what its template is
GROUP_BYTES = 8 << 20  # of pages whose suffixes are sorted together
LONG = 512  # tokens up to which common prefixes are measured
SEEN = 100_000  # streams a task remembers, so that it sends copies once

# Elements and words of the HTML standard and of common page templates.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "canvas", "iframe", "object", "audio", "video", "math"}
ASIDE = {"nav", "footer", "header", "aside", "form", "button", "select", "textarea", "dialog", "menu", "fieldset", "label", "option"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = (
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul"
).split()
BLOCK = set(BLOCK)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
MAIN_ROLES = {"main", "article"}
READERS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion"}
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "teaser", "related", "recommended"}
ASIDE_WORDS = (
    READERS
    | ADVERTS
    | {
        "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "rail", "widget", "footer", "header", "masthead", "topbar", "banner",
        "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "subscribe", "newsletter", "signup", "login",
        "share", "sharing", "social", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer", "search",
    }
)
MAIN_WORDS = {"articlebody", "article", "post", "entry", "story", "maincontent"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose id names their content, not their part in the page.
NAMED = HEADINGS | {"section", "p", "li", "dt", "dd", "td", "th", "tr", "a", "figure", "blockquote", "pre", "code", "article", "main"}


def _parts(value: str) -> set[str]:
    return {x.lower() for x in _PART.findall(value)} | set(re.findall(r"[a-z]+", value.lower()))


def _verdict(tag: str, attributes: str) -> str:
    """``aside``, ``main`` or nothing, from an element's name and its role, class and id.

    Attributes are read as names with values, so words inside other values mean nothing. The id of a heading, section or
    paragraph is an anchor; only one that is a word for reader comments as a whole counts there.
    """
    if tag in ("html", "body"):
        return ""
    role, words, hidden = "", set(), False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), entities.unescape(value.strip("\"'"))
        if name == "role":
            role = value.lower().strip()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower().strip() == "true"
        elif name == "style":
            hidden |= re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", value, re.I) is not None
        elif name in ("class", "itemprop") or name == "id" and tag not in NAMED:
            words |= _parts(value)
        elif name == "id" and value.lower() in READERS and tag not in HEADINGS:
            words.add(value.lower())
    if hidden or role in ASIDE_ROLES or tag in ASIDE:
        return "aside"
    if tag in MAIN or role in MAIN_ROLES:
        return "aside" if words & (READERS | ADVERTS) else "main"
    if words & ASIDE_WORDS:
        return "aside"
    return "main" if words & MAIN_WORDS and tag in BLOCK else ""


def parse(page: str | None) -> tuple[list[str], list[str], list[str]]:
    """Blocks of a page in order: those of its articles, those outside that nothing marks, and those marked as something else.

    References are decoded, white space is one space, empty blocks are left out.
    """
    page = page or ""
    kept: tuple[list[str], list[str], list[str]] = ([], [], [])
    stack: list[tuple[str, bool, bool]] = []  # tag, marked as something else, inside an article
    text: list[str] = []
    aside = main = heading = False

    def flush():
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if block:
                kept[2 if aside and not (heading and main) else 0 if main else 1].append(block)

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag in ("br", "hr"):
                flush() if tag == "hr" else text.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK or stack[i][0] in MAIN and tag not in ("body", "html", "main", "article"):
                    break  # an end without a start here
        else:
            if tag in BLOCK:  # a new block ends an open paragraph, and an item the item before
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == tag == "li":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            was_aside, was_main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            verdict = "aside" if tag in HIDDEN else _verdict(tag, m[4])
            # the heading of an article may stand in a header of its own
            own = tag == "header" or verdict == "aside" and re.search("header", m[4] or "", re.I)
            stack.append((tag, was_aside or verdict == "aside" and not (own and was_main), was_main or verdict == "main" and not was_aside))
            if own and was_main and not was_aside:
                stack[-1] = (f"{tag}", True, True)
        if stack:
            aside, main = stack[-1][1], stack[-1][2]
            heading = any(t in HEADINGS for t, _, _ in stack[-3:]) and _only_headers(stack)
        else:
            aside = main = heading = False
    if at < len(page):
        text.append(page[at:])
    flush()
    return kept


def _only_headers(stack: list[tuple[str, bool, bool]]) -> bool:
    """Whether all that marks this place as something else is a header inside an article."""
    marked = [s for s in stack if s[1]]
    return bool(marked) and marked[0][2] and marked[0][0] in ("header", "div", "hgroup", "section")


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of each page, those of its article first, and how many these are."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            main, rest, aside = parse(page)
            # an open page is judged by what nothing marks; of a settled one all is evidence of what its host repeats
            blocks = [*main, *rest, *(aside if main else ())]
            if not blocks:
                continue
            host, stream = host_of(url), "\n".join(blocks)
            key = host, xxhash.xxh64_intdigest(f"{len(main)}\n{stream}", 7) - (1 << 63)
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                rows.append((*key, stream, len(main)))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["host", "digest", "stream", "main"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of settled pages; host and stream of open ones."""
    for batch in batches:
        texts, hosts, digests = [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            main, rest, _ = parse(page)
            is_open = not main and bool(rest)
            texts.append(None if is_open else "\n".join(main))
            hosts.append(host_of(url))
            digests.append(xxhash.xxh64_intdigest("0\n" + "\n".join(rest), 7) - (1 << 63) if is_open else None)
        more = [pa.array(texts, pa.string()), pa.array(hosts, pa.string()), pa.array(digests, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *more], ["page_id", "url", "text", "host", "digest"])


class _Hashes(dict):
    """Numbers of a host's tokens, each worked out once."""

    def __init__(self, host: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(host)

    def __missing__(self, token: str) -> int:
        found = self[token] = xxhash.xxh64_intdigest(token, self.seed)
        return found


def _token_hashes(hashes: _Hashes, stream: str) -> np.ndarray:
    """A number for each token of a stream, a block end in front and after every block."""
    tokens = ["\n", *stream.replace("\n", " \n ").split(" "), "\n"]
    return np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))


def _run_names(tokens: np.ndarray) -> np.ndarray:
    """64-bit names of the first ``RUN`` tokens of every suffix that has them."""
    name = np.zeros(max(0, len(tokens) - RUN + 1), np.uint64)
    for i in range(RUN):
        name = (name ^ tokens[i : i + len(name)]) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and how many tokens each shares with the one before, up to ``LONG``.

    Prefix doubling: suffixes are sorted by their first three tokens, then those that tie by twice as many, until none
    do or the common prefix is longer than anything that is measured.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds, number = np.unique(tokens, return_inverse=True)
    first, width = number + 1, 1
    if len(kinds) < 1 << 20:  # three numbers fit into one; 0 stands for the end
        padded, width = np.append(first, [0, 0]), 3
        first = padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:]
    order = np.argsort(first, kind="stable")
    new = np.append(True, np.diff(first[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while width < LONG:
        first = rank[order]
        tied = np.flatnonzero((np.append(first[1:], -1) == first) | (np.append(-1, first[:-1]) == first))
        if not len(tied):
            break
        at = order[tied]
        behind = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        again = np.lexsort((behind, first[tied]))
        order[tied] = at[again]
        a, b = first[tied][again], behind[again]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        width *= 2
    shared = np.zeros(n, np.int64)
    left = np.arange(1, n)
    for step in range(LONG):
        i, j = order[left] + step, order[left - 1] + step
        ok = (i < n) & (j < n)
        left, i, j = left[ok], i[ok], j[ok]
        left = left[tokens[i] == tokens[j]]
        if not len(left):
            break
        shared[left] += 1
    return order, shared


def _pages_of(group: np.ndarray, page: np.ndarray, groups: int) -> np.ndarray:
    """Different pages in each group."""
    many = int(page.max()) + 1
    return np.bincount(np.unique(group * many + page) // many, minlength=groups)


def _group_evidence(key: tuple, rows: pa.Table) -> pa.Table:
    """What the pages of a group repeat: named runs outside articles, named blocks of articles, pages by host, open pages."""
    part, out = key[0].as_py(), []
    host, stream, main, large = (rows[c].to_pylist() for c in ("host", "stream", "main", "large"))
    pages = list({(h, d): i for i, (h, d) in enumerate(zip(host, rows["digest"].to_pylist()))}.items())
    hosts = [h for (h, _), _ in pages]
    out += [(part, "host", h, 0, n, None) for h, n in Counter(hosts).items()]
    out += [(part, "open", h, d, 1, stream[i]) for (h, d), i in pages if not main[i]]
    tokens, page, shell, starts = [], [], [], []
    hashes, total = {h: _Hashes(h) for h in set(hosts)}, 0
    for p, ((h, _), i) in enumerate(pages):
        mine = _token_hashes(hashes[h], stream[i])
        ends = np.flatnonzero(mine == mine[0])
        where = int(ends[main[i]])  # the end of the article's last block
        tokens += [mine, np.array([p], np.uint64)]  # a mark of its own ends every page
        page.append(np.full(len(mine) + 1, p))
        shell.append(np.append(np.arange(len(mine)) >= where, False))
        starts += [(total + int(ends[k]), int(ends[k + 1] - ends[k]) + 1, xxhash.xxh64_intdigest(block, xxhash.xxh64_intdigest(h, 42)), p) for k, block in enumerate(stream[i].split("\n")[: main[i]])]
        total += len(mine) + 1
    tokens, page, shell = np.concatenate(tokens), np.concatenate(page), np.concatenate(shell)
    spread = np.array([large[i] for _, i in pages])
    order, shared = suffix_array(tokens)
    # suffixes that share RUN tokens with the one before go on with its run
    run = np.cumsum(shared < RUN) - 1
    count = np.ones(int(run[-1]) + 1, np.int64)
    several = np.flatnonzero((shared >= RUN) | np.append(shared[1:] >= RUN, False))
    if len(several):
        counted = _pages_of(run[several], page[order[several]], len(count))
        count[counted > 0] = counted[counted > 0]
    names, long = _run_names(tokens), len(tokens) - RUN + 1
    wanted = np.flatnonzero(shell[order] & (order < long) & ((count[run] >= PAGES) | spread[page[order]]))
    _, at = np.unique(run[wanted], return_index=True)
    for w in wanted[at].tolist():
        out.append((part, "run", None, int(names[order[w]].astype(np.int64)), int(count[run[w]]), None))
    # blocks of articles: equal ones are neighbours among the suffixes that begin with a block
    if starts:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin, size, name, of = (np.array(c) for c in zip(*[(b, z, n - (1 << 64) if n >> 63 else n, p) for b, z, n, p in starts]))
        sort = np.argsort(place[begin])
        rank, size, name, of = place[begin][sort], size[sort], name[sort], of[sort]
        same = np.zeros(len(rank), bool)
        if len(rank) > 1:
            common = np.minimum.reduceat(shared[: rank[-1] + 1], rank[:-1] + 1)
            same[1:] = (common >= np.minimum(size[1:], LONG)) & (name[1:] == name[:-1])
        block = np.cumsum(~same) - 1
        n = _pages_of(block, of, int(block[-1]) + 1)
        lead = np.flatnonzero(~same)
        for i in lead[(n >= PAGES) | spread[of[lead]]].tolist():
            out.append((part, "block", hosts[of[i]], int(name[i]), int(n[block[i]]), None))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "kind", "host", "name", "pages", "stream"])


def _unique_runs(host: str, stream: str, repeated: np.ndarray) -> str:
    """The stream without its repeated runs: blocks they cover whole, and stretches of ``RUN`` tokens or more in others."""
    hit = np.flatnonzero(np.isin(_run_names(_token_hashes(_Hashes(host), stream)).astype(np.int64), repeated))
    tokens = ["\n", *stream.replace("\n", " \n ").split(" "), "\n"]
    edge = np.zeros(len(tokens) + RUN + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + RUN, -1)
    covered = (np.cumsum(edge)[: len(tokens)] > 0).tolist()
    blocks, ends = [], [i for i, t in enumerate(tokens) if t == "\n"]
    for start, end in zip(ends[:-1], ends[1:]):
        block, gone = tokens[start + 1 : end], covered[start + 1 : end]
        if not all(gone):
            # a run that only reaches over from the block before leaves this block's own words
            block = [t for is_gone, part in groupby(zip(block, gone), key=lambda x: x[1]) for part in [[t for t, _ in part]] if not is_gone or len(part) < RUN for t in part]
            blocks.append(" ".join(block))
    return "\n".join(b for b in blocks if b)


def _judged(streams: pa.Table, repeated: pa.Table) -> pa.Table:
    names = np.sort(repeated["run"].to_numpy()) if repeated.num_rows else np.empty(0, np.int64)
    out = [_unique_runs(h, s, names) for h, s in zip(streams["host"].to_pylist(), streams["stream"].to_pylist())]
    return pa.table([streams["host"], streams["name"], pa.array(out, pa.string())], ["host", "digest", "text"])


_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)"


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", group_bytes: int = GROUP_BYTES, broadcast_hosts: int = 100_000
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; the text is empty if there is none.

    A null or empty page has none. Repeated rows and null ids are kept; a null URL is the host of all such pages; other
    columns are ignored; an empty table gives no rows. Pages are read whole. Lists by host are broadcast up to
    ``broadcast_hosts`` rows.
    """

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_hosts else df

    kind = pages.schema[page_id].dataType.simpleString()
    raw = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    sizes = written(raw.groupBy(host.alias("host")).agg(F.sum(F.octet_length("html")).alias("size")), "hosts")
    groups = 1 + (sizes.agg(F.sum("size")).first()[0] or 0) // group_bytes
    parts = F.ceil(F.coalesce("size", F.lit(1)) / group_bytes)
    # pages are parsed where they are read, in both passes; their streams are shuffled once, copies to one group
    seen = raw.select("url", "html").mapInArrow(_streams, "host string, digest long, stream string, main long")
    dealt = seen.join(bounded(sizes.where(F.col("size") > group_bytes)), "host", "left").select(
        "host", "digest", "stream", "main", F.col("size").isNotNull().alias("large"), F.pmod(F.xxhash64("host", F.pmod("digest", parts)), F.lit(groups)).alias("part")
    )
    shape = "part long, kind string, host string, name long, pages long, stream string"
    found = written(dealt.groupBy("part").applyInArrow(_group_evidence, shape), "evidence")

    common = found.where("kind = 'run'").groupBy("name").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("name")
    runs = found.where("kind = 'run'").select(F.col("part").alias("at"), F.col("name").alias("run"))
    runs = runs.join(common.select(F.col("name").alias("run")), "run")
    judged = found.where("kind = 'open'").select("part", "host", "name", "stream").groupBy("part").cogroup(runs.groupBy("at")).applyInArrow(lambda a, b: _judged(a, b), "host string, digest long, text string")

    host_pages = found.where("kind = 'host'").groupBy("host").agg(F.sum("pages").alias("of")).where(F.col("of") >= HOST_PAGES)
    template = found.where("kind = 'block'").groupBy("host", "name").agg(F.sum("pages").alias("pages")).join(host_pages, "host")
    template = written(template.where(F.col("pages") * 2 > F.col("of")).groupBy("host").agg(F.collect_set("name").alias("gone")), "templates")

    read = raw.mapInArrow(_extracted, f"page_id {kind}, url string, text string, host string, digest long")
    blocks = F.filter(F.split("text", "\n"), lambda b: ~F.array_contains("gone", F.xxhash64("host", b)))
    judged = written(judged.select("host", "digest", F.col("text").alias("runs")), "open-pages")
    read = read.join(bounded(judged), ["host", "digest"], "left").join(bounded(template), "host", "left")
    settled = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(blocks, "\n"))
    told = read.select("page_id", "url", F.coalesce("runs", settled, F.lit("")).alias("text"))
    return told.select(F.col("page_id").alias(page_id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, folder, "pages"))
