"""Main text of web pages by union-free wrappers inferred per host.

A page becomes a stream of text blocks, each with the path of the elements around it. Equal neighbours and tandem
repeats of a few blocks fold into repeated groups. The pages of a host are then aligned one after another with the
wrapper so far: what both have is matched, what one lacks becomes optional, and a text that differs between pages turns
its fixed string into a slot. The result is a regular expression without unions: fixed texts, slots, optional and
repeated groups. Partial wrappers of the same host align in the same way, so inference combines before the shuffle.

Roles. Elements whose tag, role or whole class or id names a menu, header, footer, sidebar, advert, form or comment hold
furniture. Other names are hints. Inside an article, text under the name of a thing that sites repeat (a notice, a widget)
is furniture where it is fixed over the host's pages, and content where it varies; so is text under a longer name that
only has such a word in it (``related-work``, ``no-sidebar``). Names around an article of the longer kind say nothing. Where
no three pages show it, a whole name counts and a longer one does not. Where a page marks its article, all else in there is
text, as articles may share passages. Where it marks none, a text that stays fixed over several different pages of the
host is furniture, too.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator, Set
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Parts over which the pages of one host are dealt when wrappers meet pages.
SALTS = 32
#: Different pages of a host that must share a text before it counts as fixed.
FIXED_PAGES = 3
GROUP = 4

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "option", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "input", "label"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "status"}
#: What differs from page to page by nature: the wrapper cannot tell it from content.
PAGE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments",
    "disqus", "menu", "nav", "navbar", "navigation", "pagination", "pager", "promo", "promotion", "related", "replies",
    "reply", "respond", "share", "sharing", "skip", "sponsor", "sponsored",
}
#: What a site repeats.
SITE_WORDS = {
    "banner", "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "masthead", "modal", "newsletter", "notice",
    "notification", "popup", "sidebar", "signup", "social", "subscribe", "subscription", "toolbar", "widget",
}
FURNITURE_WORDS = PAGE_WORDS | SITE_WORDS
#: Words of place and form, which leave a furniture name whole.
FORM_WORDS = {"area", "bar", "bottom", "box", "buttons", "left", "links", "list", "posts", "right", "site", "slot", "top", "unit"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2"}
ALL_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: How far a name says furniture: not at all, a word of it does, or a whole name of what sites repeat.
PLAIN, PARTLY, SITE = range(3)


class Block:
    """A run of text between block borders: its path, its text, whether all of it is link text, and what names hint at."""

    __slots__ = ("key", "furniture", "article", "text", "linked", "hint")

    def __init__(self, key: str, furniture: bool, article: bool, text: str, linked: bool, hint: int = PLAIN):
        self.key, self.furniture, self.article, self.text, self.linked, self.hint = key, furniture, article, text, linked, hint


def _frame(tag: str, rest: str) -> tuple[str, str, bool, bool, bool, int]:
    """(tag, path step, furniture, article, header, hint) of an open element."""
    words: list[str] = []
    named, hint = False, PLAIN
    role, hidden, body = "", False, False
    if rest and "=" in rest or "hidden" in rest:
        for name, a, b, c in ATTRIBUTE.findall(rest):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                for token in html.unescape(value).split():
                    parts = [w.lower() for w in NAME_PART.findall(token) if not w.isdigit()]
                    words += parts
                    if FURNITURE_WORDS.isdisjoint(parts) or name == "id" and tag in ALL_HEADINGS:  # a heading's id is its text
                        continue
                    if not FURNITURE_WORDS.union(FORM_WORDS).issuperset(parts):
                        hint = max(hint, PARTLY)
                    elif PAGE_WORDS.isdisjoint(parts):
                        hint = SITE
                    else:
                        named = True
            elif name == "role":
                role = value.strip().lower()
            elif name == "itemprop" and "articlebody" in value.lower() or role == "main":
                body = True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
    furniture = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or hidden or named
    article = tag in ARTICLE or role in ("main", "article") or body
    if tag in ("body", "html") or article and tag in ARTICLE:
        furniture, hint = hidden, PLAIN
    return tag, f"{tag}.{'.'.join(words)}" if words else tag, furniture, article, tag == "header" or "header" in words and tag != "body", hint


def _hint(path: list[tuple], tags: set[str]) -> tuple[bool, int]:
    """(furniture, hint) of what the names along a path say."""
    start = next((k for k, s in enumerate(path) if s[3]), None)
    around, within = (path, []) if start is None else (path[:start], path[start:])
    if any(s[5] == SITE for s in around):
        return True, PLAIN
    hint = max((s[5] for s in (path if start is None else within)), default=PLAIN)
    if hint == PARTLY and start is not None and not tags.isdisjoint(ALL_HEADINGS):
        hint = PLAIN
    return False, hint


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; markup, comments and raw elements are gone, references decoded."""
    out: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked = [True]
    depth_a = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = [s for s in stack if s[0] not in INLINE]
                inside = any(s[3] for s in path)
                tags = {s[0] for s in path}
                bad = any(s[2] for s in path) or any(s[4] for s in path) and not (inside and tags & HEADINGS)
                named, hint = _hint(path, tags)
                out.append(Block("/".join(s[1] for s in path if s[0] not in ("html", "body")), bad or named, inside, text, linked[0], hint))
            parts.clear()
        linked[0] = True

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if not depth_a and not piece.isspace():
                linked[0] = False
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in INLINE:
                if tag == "a":
                    depth_a = max(0, depth_a - 1)
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            else:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        depth_a = sum(s[0] == "a" for s in stack)
                        break
            continue
        if tag in RAW:
            flush() if tag not in INLINE else None
            if not m.group(3).endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            depth_a += tag == "a"
            stack.append((tag, tag, False, False, False, PLAIN))
            continue
        flush()
        frame = _frame(tag, m.group(3))
        # a paragraph or heading ends where the next block begins, an item or cell where its sibling does
        for k in range(len(stack) - 1, -1, -1):
            other = stack[k][0]
            if other == "p" or other == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                del stack[k:]
                depth_a = sum(s[0] == "a" for s in stack)
                break
            if other not in INLINE:
                break
        if not m.group(3).endswith("/"):
            stack.append(frame)
    flush()
    return out


# ---- wrappers: a list of items [key, optional, repeated, text or None for a slot, pages with the text] ----


def _mark(text: str) -> str:
    return format(hash_of(text), "x")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def signature(blocks: list[Block]) -> list[list]:
    """The wrapper of one page: runs and tandem repeats of up to ``GROUP`` keys fold into repeated items."""
    items = [[b.key, False, False, _mark(b.text), 1] for b in blocks]
    for width in range(1, GROUP + 1):
        out: list[list] = []
        i = 0
        while i < len(items):
            keys = [x[0] for x in items[i : i + width]]
            j = i + width
            while len(keys) == width and [x[0] for x in items[j : j + width]] == keys:
                j += width
            if j > i + width:
                out += [[x[0], x[1], True, None, 1] for x in items[i : i + width]]
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(left: list[list], right: list[list]) -> list[list]:
    """The wrapper of both: matched items, with texts that differ as slots; the others optional."""
    out: list[list] = []
    for op, a, b, c, d in SequenceMatcher(None, [x[0] for x in left], [x[0] for x in right], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(left[a:b], right[c:d], strict=True):
                same = x[3] is not None and x[3] == y[3]
                out.append([x[0], x[1] or y[1], x[2] or y[2], x[3] if same else None, x[4] + y[4] if same else 1])
        else:
            out += [[x[0], True, *x[2:]] for x in left[a:b]] + [[y[0], True, *y[2:]] for y in right[c:d]]
    folded: list[list] = []
    for x in out:  # a mismatch beside its own kind is a repetition, not an option
        if folded and folded[-1][0] == x[0]:
            folded[-1] = [x[0], x[1] and folded[-1][1], True, None, 1]
        else:
            folded.append(x)
    return folded


def expression(wrapper: list[list]) -> str:
    """The wrapper as a union-free regular expression, for people."""
    return " ".join(f"({'#TEXT' if x[3] is None else 'fixed'}@{x[0]})" + ("+" if x[2] else "") + ("?" if x[1] else "") for x in wrapper)


def hint_marks(blocks: list[Block]) -> set[str]:
    """Marks of the paths and texts that only the host's other pages can judge."""
    held = [b for b in blocks if b.hint and not b.furniture]
    return {_mark(b.key) for b in held} | {_mark(b.key + "\n" + b.text) for b in held}


def is_furniture(b: Block, common: Set[str]) -> bool:
    """Whether names and the marks that ``FIXED_PAGES`` pages of the host share make a block furniture."""
    if b.furniture or b.hint == PLAIN:
        return b.furniture
    return _mark(b.key + "\n" + b.text) in common or b.hint == SITE and _mark(b.key) not in common


def main_text(blocks: list[Block], wrapper: list[list], common: Set[str] = frozenset()) -> str:
    """The blocks that the wrapper places in the main content, one per line."""
    fixed = {(x[0], x[3]) for x in wrapper if x[3] is not None and x[4] >= FIXED_PAGES}
    varied = any(x[3] is None for x in wrapper)
    clean = [b for b in blocks if not is_furniture(b, common)]
    article = [b for b in clean if b.article]
    body = article or [b for b in clean if not b.linked]
    if varied and fixed:
        body = [b for b in body if b.article or (b.key, _mark(b.text)) not in fixed] or body
    return "\n".join(b.text for b in body)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper per host as JSON, from all of its pages.

    Each task folds the pages of a host into one partial wrapper; equal pages count once within a task. Partial wrappers
    of a host, at most one per task, align in the order of their text.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrappers: dict[str, list] = {}
        seen: set[int] = set()
        for frame in frames:
            for host, page in zip(frame["host"], frame["html"], strict=True):
                sig = signature(blocks_of(page))
                if (mark := hash_of(host + "\n" + json.dumps(sig))) in seen:
                    continue
                seen.add(mark)
                wrappers[host] = align(wrappers[host], sig) if host in wrappers else sig
            if len(wrappers) > 20_000:
                yield pd.DataFrame({"host": list(wrappers), "wrapper": [json.dumps(w) for w in wrappers.values()]})
                wrappers, seen = {}, set()
        if wrappers:
            yield pd.DataFrame({"host": list(wrappers), "wrapper": [json.dumps(w) for w in wrappers.values()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(set(frame["wrapper"]))
        wrapper = json.loads(parts[0])
        for other in parts[1:]:
            wrapper = align(wrapper, json.loads(other))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(partial, "host string, wrapper string").groupBy("host").applyInPandas(merge, "host string, wrapper string")


def common_marks(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, common): the marks of hinted blocks that at least ``FIXED_PAGES`` different pages of a host share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for host, page in zip(frame["host"], frame["html"], strict=True):
                if marks := hint_marks(blocks_of(page)):
                    out += [(host, m, _mark(page)) for m in sorted(marks)]
            yield pd.DataFrame(out, columns=["host", "mark", "page"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    seen = rows.mapInPandas(run, "host string, mark string, page string")
    often = seen.groupBy("host", "mark").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= FIXED_PAGES)
    return often.groupBy("host").agg(F.collect_list("mark").alias("common"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = SALTS) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null and empty html give an empty text. A null or odd url belongs to the host "". Rows that repeat an id are pages of
    their own. A host's pages are dealt to ``salts`` keys to meet their wrapper. An empty table gives an empty result.
    Other columns are ignored.
    """
    wrappers = infer_wrappers(pages, url_col, html_col).join(common_marks(pages, url_col, html_col), "host", "left")
    wrappers = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = rows.join(wrappers, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper", "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            known = {w: json.loads(w) for w in column["wrapper"].unique().to_pylist() if w is not None}
            texts = []
            for page, w, c in zip(column["html"].to_pylist(), column["wrapper"].to_pylist(), column["common"].to_pylist(), strict=True):
                texts.append(main_text(blocks_of(page), known.get(w, []), frozenset(c or ())))
            yield pa.RecordBatch.from_arrays([column["page_id"], column["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    return joined.mapInArrow(trimmed(run), f"page_id {kind}, url string, text string, n_chars long")
