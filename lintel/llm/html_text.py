"""Main text of web pages by equivalence classes of template tokens.

A page's structural tokens are its block elements, each named by its path of
element names and classes; its text tokens are its blocks, each named by its path
and a 64-bit hash of its text.  Over the pages of a host, the occurrence vector of
a token is how often each page has it; tokens with one vector are an equivalence
class.  Vectors are compared by order-free fingerprints (an exclusive or of page
and count hashes, with the numbers of pages and occurrences), so a host of any
size is a partial aggregation and never a group in one task.  A class is valid if
its tokens are on at least half of the host's pages, with text tokens on at least
``REPEATED``; valid classes nest by the paths of their tokens and give the host's
template.  A text token in the class of an element around it is template: wherever
that element stands, it says the same.  All other text stands in slots between
template tokens, also text that recurs on some pages with an element and not on
others.  The main slot is the article or main element if the template has one.  Else
it is the whole page: no share of the text decides, so a heading or a short part
beside a long one stays.  Template text goes from the main slot, a notice inside the
article that is the same on all pages of a host too.  Where template text is half of
an article or more (by characters), the pages are copies and not a notice, and all of
it stays; a page of template text alone keeps it.  Of each page, the blocks in the main slot remain, without any
menu, header, footer, sidebar, notice, advert, form or comment list inside it.  A page
that lacks its host's article or main slot (or whose host has no template) is judged
by its own tokens alone: its article and main elements, or else the whole page.

An element is a menu, header and so on by its name or by the parts of its class, id
and role.  Parts in ``ALWAYS`` are enough; those in ``ALONE`` count only if all other
parts of the name are in ``CHROME`` ("site-header", not "article-header"; "cookie-bar", not
"cookie-recipe").  Names that begin with a part of ``LAYOUT`` ("has-sidebar") are those of
elements around.  A heading is never one by its own name, and headings in an article's header element stay.

Blocks are split at block elements; character references are decoded, white
space becomes one space, and blocks are joined by an empty line.  Elements that lie
deeper than ``DEPTH`` have the token of the element at that depth, so a page whose
elements are never closed takes time in proportion to its length; its text is whole.

Defined results: a null html is an empty page with an empty text; a tag, comment
or reference cut off at the end of a page is no text (a cut reference stays as it
is); a null url has the empty host; repeated rows each get a row and count twice
in the vectors; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import small_batches
from .scratch import Scratch

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "svg",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"button", "caption", "legend", "option", "select", "summary", "svg", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "head"}
DROP = {"aside", "button", "dialog", "footer", "form", "head", "header", "menu", "nav", "select", "svg"}
ALWAYS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "breadcrumb", "breadcrumbs", "comment", "commentform", "commentlist", "comments", "consent", "disqus", "gdpr", "masthead", "nav", "navbar",
    "navigation", "newsletter", "popup", "replies", "respond", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar", "contentinfo", "complementary", "alertdialog",
}
ALONE = {"alert", "banner", "cookie", "cookies", "copyright", "footer", "header", "login", "menu", "modal", "notice", "notices", "promo", "promotion", "related", "search", "share", "sharing", "social", "widget"}
CHROME = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "desktop", "fixed", "form", "global", "icons", "inner", "item", "items", "left",
    "link", "links", "list", "main", "media", "mobile", "news", "outer", "overlay", "page", "panel", "posts", "right", "row", "section", "site", "sticky", "stories", "top", "wrap", "wrapper",
}
#: First parts of names that say how an element around such a part is laid out.
LAYOUT = ("has", "with", "without", "no", "left", "right")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = ("article", "main")


#: Elements of a path in a token.
DEPTH = 64
#: An equivalence class by its fingerprint: vector, pages and occurrences.
Class = tuple[int, int, int]


class Block:
    """A stretch of text: where it stands, what it says, how much of it is in links."""

    __slots__ = ("path", "dropped", "text", "linked")

    def __init__(self, path: tuple[str, ...], dropped: bool, text: str, linked: int):
        self.path, self.dropped, self.text, self.linked = path, dropped, text, linked


def named(value: str) -> bool:
    """Whether one class, id or role names a part of a page that is not its text."""
    parts = [p for p in re.split(r"[_-]+", value) if p and not p.isdigit()]
    if len(parts) > 1 and parts[0] in LAYOUT:
        return False
    known = set(parts)
    return bool(known & ALWAYS) or bool(known & ALONE) and known <= ALWAYS | ALONE | CHROME


def parse(page: str) -> tuple[dict[tuple[str, ...], int], list[Block]]:
    """Occurrences of each structural token, and the blocks in page order."""
    #: element, its name in paths, whether it or one around it is dropped, and whether by an article's header element alone
    stack: list[tuple[str, str, bool, bool]] = []
    tokens: dict[tuple[str, ...], int] = {}
    blocks: list[Block] = []
    parts: list[str] = []
    opened: Counter[str] = Counter()
    link, linked, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(Block(tuple(s[1] for s in stack[:DEPTH]), bool(stack) and stack[-1][2], text, linked))
        linked = 0

    while at < n:
        m = TAG.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            text = html.unescape(page[at:upto])
            parts.append(text)
            linked += len(text) if link else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[5]), m[3] or m[7] or ""
        if not (m[4] or m[8]):
            break  # cut off
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "br" or name == "hr":
            parts.append(" ")
        if name == "a":
            link = 0 if closing else 1
        if name not in BLOCK or name in VOID:
            continue
        flush()
        if closing:
            while opened[name]:
                opened[gone := stack.pop()[0]] -= 1
                if gone == name:
                    break
            continue
        if name in ENDS_P and stack and stack[-1][0] == "p":
            opened[stack.pop()[0]] -= 1
        if stack and stack[-1][0] in CLOSES.get(name, ()):
            opened[stack.pop()[0]] -= 1
        chrome, label = False, name
        for a in ATTRIBUTE.finditer(attributes):
            values = (a[2] or a[3] or a[4] or "").lower().split()
            chrome = chrome or any(named(v) for v in values)
            if a[1].lower() == "class":
                label = ".".join([name, *sorted(values)])
        _, _, inside, by_header = stack[-1] if stack else ("", "", False, False)
        own = name in DROP or (chrome and name not in ("html", "body", *MAIN) and name not in HEADINGS)
        if name in HEADINGS and by_header:
            inside = by_header = False
        elif own and not inside:
            by_header = name == "header" and not chrome and any(opened[m] for m in MAIN)
        elif own:
            by_header = False
        stack.append((name, label, inside or own, by_header))
        opened[name] += 1
        path = tuple(s[1] for s in stack[:DEPTH])
        tokens[path] = tokens.get(path, 0) + 1
    flush()
    return tokens, blocks


def host(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mix(x: int) -> int:
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 33)


#: Most (host, token) pairs that a task adds up before it sends them on.
HELD = 50_000
#: Fewest pages with a text for it to be template: on two, template and copy look the same.
REPEATED = 3


def said(text: str) -> str:
    """What names a text in its token."""
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, str], list[int]] = {}

    def send() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in found.items()]
        found.clear()
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "token", "pages", "occurrences", "chars", "vector"])

    for batch in batches:
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            name, page = host(url), page or ""
            tokens, blocks = parse(page)
            size: dict[tuple[str, ...], int] = {}
            for b in blocks:
                if not b.dropped:
                    for k in range(1, len(b.path) + 1):
                        size[b.path[:k]] = size.get(b.path[:k], 0) + len(b.text) - b.linked
            own = _mix(zlib.crc32(page.encode("utf-8", "replace")) << 32 ^ (page_id or 0))
            # A newline stands in no path: it parts a text token's path and hash.
            texts = Counter(f"{' '.join(b.path)}\n{said(b.text)}" for b in blocks if not b.dropped)
            sized = [(" ".join(path), n, size.get(path, 0)) for path, n in [*tokens.items(), ((), 1)]]
            for token, n, chars in [*sized, *((t, n, 0) for t, n in texts.items())]:
                v = found.setdefault((name, token), [0, 0, 0, 0])
                v[0] += 1
                v[1] += n
                v[2] += chars
                v[3] = _signed((v[3] ^ _mix(own + n)) & 0xFFFFFFFFFFFFFFFF)
            if len(found) >= HELD:
                yield send()
    yield send()


#: Most template rows and characters sent to every executor; more are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_CHARS = 20_000, 16_000_000


def templates(pages: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """host, nodes: the valid tokens of each host with class, pages, occurrences and characters of text."""
    keep = keep or Scratch(pages.sparkSession, "html")
    seen = pages.mapInArrow(_observe, "host string, token string, pages long, occurrences long, chars long, vector long")
    tokens = seen.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"), F.sum("chars").alias("chars"), F.bit_xor("vector").alias("vector"))
    tokens = keep.keep(tokens.where(f"pages >= {REPEATED} or not contains(token, '\n')"), "tokens")
    # The empty token is on every page of its host: a token is valid if it is on half of them.
    total = tokens.where("token = ''").select("host", F.col("pages").alias("total"))
    total = F.broadcast(total) if total.count() <= BROADCAST_HOSTS else total
    valid = tokens.join(total, "host").where("total >= 2 and 2 * pages >= total and token <> ''")
    return valid.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("token", "vector", "pages", "occurrences", "chars"))).alias("nodes"))


class Template:
    """Classes of a host's structural tokens, the template texts nested in them, and the main slot."""

    def __init__(self, nodes: list[dict]):
        elements, said_at = [], []
        #: class of each structural token
        self.of: dict[tuple[str, ...], Class] = {}
        for x in nodes:
            path, _, text = x["token"].partition("\n")
            path, own = tuple(path.split()), (x["vector"], x["pages"], x["occurrences"])
            if text:
                said_at.append((path, text, own))
                continue
            elements.append((path, x))
            self.of[path] = own
        #: template texts: path and hash
        self.texts = {(path, text) for path, text, own in said_at if own in self.around(path)}
        mains = [(p, x) for p, x in elements if x["occurrences"] == x["pages"] and p[-1].split(".")[0] in MAIN and not dropped(p)]
        self.main = max(mains, key=lambda y: (y[1]["pages"], y[1]["chars"], -len(y[0])))[0] if mains else None

    def around(self, path: tuple[str, ...]) -> set[Class]:
        """The classes that a text is nested in: those of the elements it stands in."""
        return {self.of[path[:k]] for k in range(1, len(path) + 1) if path[:k] in self.of}


def dropped(path: tuple[str, ...]) -> bool:
    for label in path:
        name, *classes = label.split(".")
        if name in DROP or (name not in ("html", "body", *MAIN) and name not in HEADINGS and any(map(named, classes))):
            return True
    return False


def main_text(page: str | None, template: Template | None) -> str:
    tokens, blocks = parse(page or "")
    slots: list[tuple[str, ...]] = [()]
    if template is not None and template.main in tokens:
        slots = [template.main]
    elif template is None or not template.of or template.main:
        slots = [p for p in tokens if p[-1].split(".")[0] in MAIN and not dropped(p)] or slots
    kept = [b for b in blocks if not b.dropped and any(b.path[: len(s)] == s for s in slots)]
    if template is not None and template.texts:
        own = [b for b in kept if (b.path, said(b.text)) not in template.texts]
        if slots == [()] or 2 * sum(len(b.text) for b in own) > sum(len(b.text) for b in kept):
            kept = own or kept
    return "\n\n".join(b.text for b in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, Template] = {}
    for batch in batches:
        nodes, out = batch.column("nodes"), []
        for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            name = host(url)
            if name not in kept:
                if len(kept) >= 1000:
                    kept.clear()
                kept[name] = Template(nodes[i].as_py() or [])
            out.append(main_text(page, kept[name]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark: SparkSession = pages.sparkSession
    small_batches(spark)
    keep = Scratch(spark, "html")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = keep.keep(templates(rows, keep), "templates")
    hosts, chars = found.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + F.length(x["token"]) + 40)), F.lit(0))).first()
    name = F.coalesce(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit(""))
    joined = rows.withColumn("host", name).join(F.broadcast(found) if hosts <= BROADCAST_HOSTS and chars <= BROADCAST_CHARS else found, "host", "left")
    return joined.select("page_id", "url", "html", "nodes").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
