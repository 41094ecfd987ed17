"""Main text of web pages by site template removal.

Pass 1 parses every page and hashes all of its block subtrees (start tag to end tag), in menus and adverts as in
articles; only those that hold an article or a headline can't be template. Per host, Spark counts on how
many different pages each subtree stands (copies of a page count once). Pass 2 parses again, deletes the
subtrees that recur across many pages of the host (n_templates says how many), and joins the blocks that are left.

A subtree is template outside the article on at least max(`outside_pages`, `outside_share` of the host's
pages), inside it on at least max(`inside_pages`, `inside_share`). So a host has at most
1 / outside_share times as many template subtrees as one of its pages has elements; they travel to the
pages by broadcast while at most broadcast_rows of them exist, else by a join on the host, where the pages of a
large host are salted over tasks of `salt_pages` each.

A host with few pages has no recurrence, and menus differ from page to page. So what markup alone tells apart goes
without a count, too: scripts, styles, forms, menus, headers and footers,
asides, and elements whose class, id or role says advert, notice, sidebar or reader comment. Where a page has
an article or main element with text, only that is read.

Null or empty html, or none but template: empty text. A null url has no host and loses no template. A
truncated tag at the end is dropped, truncated references stay as they are. Repeated rows are rows, a null
page_id is a row. An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delver.llm.common import stored

TOKEN = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul head title button select textarea noscript hr".split()
)
SPACE = frozenset("br td th img".split())
DROP = frozenset("head title script style template noscript iframe object embed svg math canvas audio video nav footer aside form button select textarea input option dialog menu map noembed noframes xmp".split())
#: An open element (key) that the start of one of these ends, up to a boundary.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}
BOUND = frozenset("ul ol dl table select div section article main body aside nav header footer form blockquote".split())
ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
TELLING = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden)\b", re.I)
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comments comment disqus replies footer header masthead pagination pager widget toolbar copyright login search".split()
)
GOOD = re.compile(r"article|post|entry|content|main|body|story|text", re.I)
COMMENT = re.compile(r"comment|disqus|repl(?:y|ies)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def unwanted(tag: str, attrs: str) -> bool:
    """Whether class, id, role or style of an element says that it isn't article text."""
    if tag in ("html", "body") or not TELLING.search(attrs):
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id"):
            for word in value.split():
                if tag in ("article", "main"):
                    if COMMENT.search(word):
                        return True
                elif not BAD.isdisjoint(re.split(r"[-_:]+", word)) and (COMMENT.search(word) or not GOOD.search(word)):
                    return True
    return False


def parse(html: str, template: frozenset[int] | set[int] | None = None, hashes: dict[int, bool] | None = None) -> tuple[str, int]:
    """(text, template subtrees); subtrees with a hash in template are deleted. hashes, if given, gets subtree hash -> inside the article."""
    blocks: list[tuple[str, bool]] = []
    now: list[str] = []
    # (tag, start, dropped, blocks before, inside an article, holds a headline or an article)
    stack: list[list] = []
    inside = dropped = gone = 0

    def flush() -> None:
        if now:
            if text := " ".join(unescape("".join(now)).split()):
                blocks.append((text, inside > 0))
            now.clear()

    def pop(end: int) -> None:
        nonlocal inside, dropped, gone
        tag, start, drop, before, within, holds = stack.pop()
        if tag in BLOCK:
            flush()
            if not holds and tag not in ("html", "body") and (hashes is not None or template):
                h = xxhash.xxh3_64_intdigest(html[start:end]) >> 1 << 1 | (inside > 0)
                if hashes is not None:
                    hashes[h] = inside > 0
                elif h in template:  # type: ignore[operator]
                    gone += 1
                    del blocks[before:]
        dropped -= drop
        inside -= within
        if holds and stack:
            stack[-1][5] = True

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            break
        start, end = m.span()
        if start > at and not dropped:
            now.append(html[at:start])
        at = end
        name = m[2] or m[6]
        if not name:
            continue
        tag = name.lower()
        if m[4] == "" or (m[4] is None and html[end - 1] != ">"):  # cut off inside a tag
            break
        if m[1] or m[5]:
            if tag == "p" and not any(x[0] == "p" for x in stack):
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k + 1:
                        pop(start)
                    pop(end)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        attrs = m[3] if m[3] is not None else m[7] or ""
        if tag in BLOCK:
            if not dropped:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop(start)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag == "body" or (tag in BLOCK and tag not in ("head", "title", "noscript", "html")):
            while any(x[0] == "head" for x in stack):
                pop(start)
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    while len(stack) > k:
                        pop(start)
                    break
                if stack[k][0] in BOUND:
                    break
        if tag in SPACE and not dropped:
            now.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "main":
            while dropped and stack:
                pop(start)
        if attrs.endswith("/") and tag in ("script", "svg", "path"):
            continue
        if tag in RAW:
            close = RAW[tag].search(html, end)
            until = close.start() if close else size
            gt = html.find(">", until) if close else -1
            at = gt + 1 if gt >= 0 else size
            continue
        drop = tag in DROP or (tag == "header" and not inside) or unwanted(tag, attrs)
        within = tag in ("article", "main") and not drop and not dropped
        if within:
            flush()
        dropped += drop
        inside += within
        stack.append([tag, start, drop, len(blocks), within, tag in ("article", "main", "h1")])
    else:
        m = None
    if m is None and at < size and not dropped:
        now.append(html[at:])
    while stack:
        pop(size)
    flush()
    if any(b for _, b in blocks):
        return "\n".join(t for t, b in blocks if b), gone
    return "\n".join(t for t, _ in blocks), gone


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, subtree, page content); subtree 0 stands for the page itself."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            hosts, subtrees, pages = [], [], []
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found: dict[int, bool] = {}
                parse(html, None, found)
                page = xxhash.xxh3_64_intdigest(html) - (1 << 63)
                for h in (0, *found):
                    hosts.append(host)
                    subtrees.append(h - (1 << 63))
                    pages.append(page)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(pages, pa.int64())], ["host", "subtree", "page"])


def templates(pages: DataFrame, outside_pages: int = 5, outside_share: float = 0.1, inside_pages: int = 8, inside_share: float = 0.5) -> DataFrame:
    """(host, subtree): the template subtrees of each host of pages(host, html)."""
    found = pages.where("host is not null and html is not null").select("host", "html").mapInArrow(_count, "host string, subtree long, page long")
    count = found.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    count = stored(pages.sparkSession, count.where("n > 1"), "subtrees")
    none = F.lit(-(1 << 63))
    total = count.where(F.col("subtree") == none).select("host", F.col("n").alias("of"))
    within = F.col("subtree").bitwiseAND(1) == 1
    least = F.when(within, F.greatest(F.lit(float(inside_pages)), F.lit(inside_share) * F.col("of"))).otherwise(F.greatest(F.lit(float(outside_pages)), F.lit(outside_share) * F.col("of")))
    return count.where((F.col("subtree") != none) & (F.col("n") >= min(outside_pages, inside_pages))).join(total, "host").where(F.col("n") >= least).select("host", "subtree")


_OUT = "page_id long, url string, text string, n_chars long, n_templates long"


def _emit(part: pa.RecordBatch, found: list[tuple[str, int]]) -> pa.RecordBatch:
    texts = [t for t, _ in found]
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_templates"])


def extract(pages: DataFrame, broadcast_rows: int = 500_000, salt_pages: int = 50_000, **limits: float) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars, n_templates."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract("url", HOST, 1))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.length(host) > 0, host).alias("host"))
    found = stored(spark, templates(pages, **limits), "templates")
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table: dict[str, set[int]] = {}
        for r in found.collect():
            table.setdefault(r.host, set()).add(r.subtree + (1 << 63))
        known = spark.sparkContext.broadcast(table)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none: set[int] = set()
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    yield _emit(part, [parse(h, known.value.get(s, none)) if h else ("", 0) for h, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)])

        return pages.mapInArrow(run, _OUT)
    per_host = found.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))  # bounded: see above

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                bad = [{x + (1 << 63) for x in own or ()} for own in part.column(3).to_pylist()]
                yield _emit(part, [parse(h, b) if h else ("", 0) for h, b in zip(part.column(2).to_pylist(), bad, strict=True)])

    size = pages.where("host is not null").groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > salt_pages)
    salts = per_host.join(size, "host", "left").withColumn("salts", F.coalesce(F.ceil(F.col("n") / salt_pages), F.lit(1)).cast("int"))
    of = salts.where("salts > 1").select("host", "salts")
    salted = pages.join(F.broadcast(of) if of.limit(10_001).count() <= 10_000 else of, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    each = salts.select("host", "subtrees", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return salted.join(each, ["host", "salt"], "left").select("page_id", "url", "html", "subtrees").mapInArrow(joined, _OUT)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
