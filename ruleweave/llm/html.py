"""Main text of web pages by page structure and a suffix array over each host's pages.

A page becomes blocks of white-space separated tokens. Inside a menu, header, footer, sidebar, notice, advert, form,
script, style or comment section they are furniture. Text blocks of the article or main element (paragraphs, headings,
quotations, tables) are article. Other blocks inside it, such as plain divisions and list items, and sections of related
links or share buttons, are widgets; blocks outside of it are plain. The host suffix array judges widgets, and the plain
blocks of pages without an article:

1. The token streams of pages (all but article blocks) are concatenated, some megabytes at a time, and their suffix
   array is built by rank doubling up to `RUN` tokens. Of each distinct run of `RUN` tokens it tells the hosts and the
   distinct pages that hold it.
2. Runs are merged by host and hash: those on at least `REPEATS` pages of different content are boilerplate. Counts are
   exact over all pages of the host, whatever the partitioning; a run that most pages of a host share is combined in
   each task first. Pages of equal content count once.
3. Judged blocks that boilerplate runs cover wholly go, others lose the runs that lie inside them, so a run that goes on
   into the next block doesn't take that block's own words. Unique runs stay.

Article blocks are never cut, as articles quote and copy each other.

Cases: a null or blank html gives the empty text; broken markup is read as far as it goes; elements left open end
with their parent or the page; a host of one page has no repeats; a url without a host counts as a host of its own;
repeated rows are separate pages of one content; empty tables give empty results; columns other than page_id, url and
html are not read.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table

RUN = 8
REPEATS = 3

FURNITURE, PLAIN, WIDGET, ARTICLE = 0, 1, 2, 3

#: Elements whose content is never main text, raw-text elements, elements without an end, and blocks.
RAW = "script style noscript template textarea title iframe svg audio video select".split()
DROPPED = "nav footer aside form button dialog menu".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
#: Words in class, id or role that mark furniture.
MARKS = (
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion sidebar side-bar cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup comment comments disqus reply replies respond breadcrumb breadcrumbs "
    "nav navbar navigation menu footer masthead pagination pager skip alert complementary contentinfo dialog "
    "site-header page-header site-footer page-footer"
).split()
#: Words in class, id or role that make a block a widget, and blocks that are widgets inside an article.
SUSPECT = "share sharing social related recommended search toolbar".split()
CONTAINERS = "div section ul ol li menu details summary address figure".split()

#: A tag without < in its quotes, as most are; it looks no further than the next <, so it costs a page no second reading.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'<]*+)(?=[\s/>])([^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+)>""")
_SPECIAL = re.compile("[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW, _DROPPED, _VOID, _BLOCKS, _MARKS, _SUSPECT, _CONTAINERS = map(frozenset, (RAW, DROPPED, VOID, BLOCKS, MARKS, SUSPECT, CONTAINERS))
_RAW_END = {n: re.compile(rf"</{n}", re.I) for n in RAW}
_PART = re.compile(r"[\s_]+")


class _Scanner:
    """The markup of a page from left to right, in time that grows with its length, however broken it is.

    Where a tag ends depends only on the place of the next quote or > outside of quotes, so what was once found to be open up
    to the end of the page is not read again.
    """

    def __init__(self, html: str):
        self.html = html
        self.ends: dict[int, int] = {}
        self.found = {_SPECIAL: (0, -1), _NAME_END: (0, -1)}

    def _next(self, pattern: re.Pattern, at: int) -> int:
        """Place of the first match from `at` on, or the page's length."""
        start, place = self.found[pattern]
        if not start <= at <= place:
            m = pattern.search(self.html, at)
            place = m.start() if m else len(self.html)
            self.found[pattern] = at, place
        return place

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, or -1. Quoted parts are passed over."""
        html, path = self.html, []
        place = self._next(_SPECIAL, at)
        while True:
            if place in self.ends:
                end = self.ends[place]
                break
            path.append(place)
            if place == len(html):
                end = -1
                break
            if html[place] == ">":
                end = place
                break
            close = html.find(html[place], place + 1)
            if close < 0:
                end = -1
                break
            m = _SPECIAL.search(html, close + 1)
            place = m.start() if m else len(html)
        for x in path:
            self.ends[x] = end
        return end

    def token(self, pos: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" of an end tag, name, attributes) of the next markup from pos on; comments have no name."""
        html, start = self.html, self.html.find("<", pos)
        while start >= 0:
            if m := _PLAIN_TAG.match(html, start):
                return start, m.end(), m[1], m[2], m[3]
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, "", "", ""
            if html.startswith(("<!", "<?"), start):
                end = html.find(">", start + 2)
                return start, len(html) if end < 0 else end + 1, "", "", ""
            first = start + 1 + html.startswith("</", start)
            if html[first : first + 1].isascii() and html[first : first + 1].isalpha():
                name_end = self._next(_NAME_END, first)
                end = self._tag_end(name_end)
                if end >= 0:
                    return start, end + 1, html[start + 1 : first], html[first:name_end], html[name_end:end]
            start = html.find("<", start + 1)
        return None


def _sort(name: str, attrs: str, in_article: bool) -> int | None:
    """FURNITURE or WIDGET where an element's name or attributes tell, else None."""
    if name in _DROPPED or (name == "header" and not in_article):
        return FURNITURE
    if not attrs or name in ("html", "body", "main"):
        return None
    found = None
    for m in _MARKED.finditer(attrs):
        for word in _PART.split((m[1] or m[2] or m[3] or "").lower()):
            parts = {word, *((word.split("-")[0], word.rsplit("-")[-1]) if "-" in word else ())}
            if not _MARKS.isdisjoint(parts):
                return FURNITURE
            if not _SUSPECT.isdisjoint(parts):
                found = WIDGET
    return found


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the page's blocks in order; text has single blanks only."""
    if not html:
        return []
    out: list[tuple[str, int]] = []
    held: list[str] = []
    skip, depth = "", 0  # the open element that is furniture, and how many of its name are open inside
    article: list[str] = []  # open article and main elements
    inner = ""  # the block that was opened last, if none has ended since
    suspect, inside = "", 0  # the open element that is a widget, and how many of its name are open inside
    pos, end = 0, len(html)
    scanner = _Scanner(html)

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, FURNITURE if skip else PLAIN if not article else WIDGET if suspect or inner in _CONTAINERS else ARTICLE))

    while pos < end:
        found = scanner.token(pos)
        if not found:
            held.append(html[pos:])
            break
        start, stop, closing, name, attrs = found
        held.append(html[pos:start])
        pos = stop
        if not name:
            continue
        name = name.lower()
        if name in _BLOCKS:
            close()
            inner = "" if closing else name
        elif name == "br":
            held.append(" ")
        if closing:
            if skip:
                if name == skip:
                    depth -= 1
                    if not depth:
                        close()
                        skip = ""
                continue
            if suspect and name == suspect:
                inside -= 1
                if not inside:
                    close()
                    suspect = ""
            if article and name == article[-1]:
                article.pop()
            continue
        if name in _RAW:
            if not attrs.endswith("/"):
                last = _RAW_END[name].search(html, pos)
                close_at = html.find(">", last.end()) if last else -1
                pos = close_at + 1 if close_at >= 0 else end
            continue
        if skip:
            depth += name == skip
        elif name not in _VOID:
            sort = _sort(name, attrs, bool(article))
            if sort == FURNITURE:
                close()
                skip, depth = name, 1
                continue
            if suspect:
                inside += name == suspect
            elif sort == WIDGET:
                close()
                suspect, inside = name, 1
            if name in ("article", "main"):
                article.append(name)
    close()
    return out


# -- the suffix array of a host ------------------------------------------------------------------------


def streams(page: list[tuple[str, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of a page's blocks other than article ones, the number of each token's block, and whether it is judged."""
    has_article = any(kind in (ARTICLE, WIDGET) for _, kind in page)
    tokens: list[str] = []
    sizes, judged = [], []
    for text, kind in page:
        words = text.split(" ") if kind != ARTICLE else []
        tokens += words
        sizes.append(len(words))
        judged.append(kind == WIDGET or (kind == PLAIN and not has_article))
    return tokens, np.repeat(np.arange(len(page)), sizes), np.repeat(np.array(judged, bool), sizes)


def _run_hash(tokens: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")) - (1 << 63)


def repeated_runs(hosts: list[str], pages: list[list[tuple[str, int]]], contents: list[bytes], run: int = RUN, repeats: int = REPEATS):
    """(host, hash of a run, content, judged) of the pages' token streams, by their suffix array.

    All judged occurrences are given, once a content, and of the others as many contents as it takes to be boilerplate.
    """
    ids: dict[str, int] = {}
    made = [streams(p) for p in pages]
    sizes = np.array([len(t) for t, _, _ in made])
    total = int(sizes.sum())
    if not total:
        return
    flat = np.fromiter((ids.setdefault(w, len(ids)) for t, _, _ in made for w in t), np.int64, total)
    page = np.repeat(np.arange(len(pages)), sizes)
    judged = np.r_[0, np.cumsum(np.concatenate([j for _, _, j in made]))]
    start = np.flatnonzero(np.arange(total) + run <= np.repeat(np.cumsum(sizes), sizes))
    if not len(start):
        return
    rank, span = flat, 1
    while span < run:  # rank doubling; the last step overlaps so that exactly `run` tokens count
        step = min(span, run - span)
        key = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        span += step
    number = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
    host = np.array([number[h] for h in hosts])
    content = np.unique(np.array(contents, object).astype("S16"), return_inverse=True)[1]
    open_ = judged[start + run] > judged[start]
    sa = np.lexsort((~open_, content[page[start]], host[page[start]], rank[start]))
    start, open_ = start[sa], open_[sa]
    h, c, r = host[page[start]], content[page[start]], rank[start]
    group = np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])]
    new = group | np.r_[True, c[1:] != c[:-1]]  # a content's first occurrence is a judged one if it has any
    start, open_, group = start[new], open_[new], np.cumsum(group[new])
    begin = np.r_[True, group[1:] != group[:-1]]
    place = np.arange(len(group)) - np.maximum.accumulate(np.where(begin, np.arange(len(group)), 0))
    offset = np.cumsum(sizes) - sizes
    last, value = 0, 0
    for i in np.flatnonzero(open_ | (place < repeats)):
        at, p = int(start[i]), int(page[start[i]])
        if group[i] != last:
            k = at - int(offset[p])
            last, value = group[i], _run_hash(made[p][0][k : k + run])
        yield hosts[p], value, contents[p], bool(open_[i])


def page_text(page: list[tuple[str, int]], boilerplate: set[int] | None = None, run: int = RUN) -> str:
    """Main text of a page: its article, or its plain blocks, without what boilerplate runs cover in judged blocks."""
    has_article = any(kind in (ARTICLE, WIDGET) for _, kind in page)
    tokens, block, judged = streams(page) if boilerplate else ([], np.empty(0, int), np.empty(0, bool))
    mark, inner = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    for k in range(len(tokens) - run + 1):
        if judged[k : k + run].any() and _run_hash(tokens[k : k + run]) in boilerplate:
            mark[k : k + run] = True
            if block[k] == block[k + run - 1]:
                inner[k : k + run] = True
    kept = []
    for i, (text, kind) in enumerate(page):
        if kind == ARTICLE:
            kept.append(text)
        elif kind == WIDGET or (kind == PLAIN and not has_article):
            a, b = np.searchsorted(block, (i, i + 1)) if boilerplate else (0, 0)
            rest = text
            if a < b and mark[a:b].any():
                rest = "" if mark[a:b].all() else " ".join(w for w, gone in zip(tokens[a:b], inner[a:b], strict=True) if not gone)
            if rest:
                kept.append(rest)
    return "\n".join(kept)


def _content(html: str | None) -> bytes:
    import hashlib

    return hashlib.md5((html or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def extract(pages: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """page_id, url and text of every page."""
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.nullif(host, F.lit("")), F.col("url"), F.lit("")))

    def look(batches):
        for part in slices(batches, "html"):
            hosts, htmls = part.column("host").to_pylist(), part.column("html").to_pylist()
            found = list(repeated_runs(hosts, [blocks(x) for x in htmls], [_content(x) for x in htmls], repeats=repeats))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.bool_()))], names=["host", "run", "content", "judged"])

    seen = saved(rows.select("host", "html").mapInArrow(look, "host string, run long, content binary, judged boolean"))
    counted = seen.groupBy("host", "run", "content").agg(F.max("judged").alias("judged")).groupBy("host", "run").agg(F.count("*").alias("n"), F.max("judged").alias("judged"))
    runs = counted.where((F.col("n") >= repeats) & F.col("judged")).select("host", "run")
    cuts = saved(seen.where("judged").join(runs, ["host", "run"]).groupBy("host", "content").agg(F.collect_set("run").alias("runs")))
    judged = rows.withColumn("content", F.unhex(F.md5(F.coalesce("html", F.lit(""))))).join(cuts, ["host", "content"], "left")

    def answer(batches):
        for part in slices(batches, "html"):
            runs = part.column("runs").to_pylist()
            texts = [page_text(blocks(x), set(r) if r else None) for x, r in zip(part.column("html").to_pylist(), runs, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return judged.select("page_id", "url", "html", "runs").mapInArrow(answer, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
