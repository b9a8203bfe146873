"""Operator 9, HTML extraction with a site style tree.

The DOMs of one host are merged by element path. A path's content importance is one minus the
mean entropy of its texts over the host's pages: a text that every page repeats says nothing.
An element's presentation importance is the entropy of the child sequences that pages give it.
Branches of low composite importance are removed from each page, inside and outside the element
that marks itself as the main content: that mark raises a path's importance, no more. Besides, an
element goes whose tag, role or class says that it is a menu, an advert, a form, comments and so
on. Pages of a host with equal blocks are copies and count once, so that copies do not make their
text look repeated.

Only hashes of (host, path, value, page content) are shuffled, made distinct before the shuffle,
so no key holds more than one host's different contents. What comes back to the pages is each
host's list of unimportant paths.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

#: Composite importance below which a branch is removed; pages that a host is taken to have besides, so that few equal pages prove
#: little; the weights of presentation and of a main element's mark.
THRESHOLD, UNSEEN, PRESENTATION, MARKED = 0.2, 2, 0.1, 0.1

#: Fixed values of HTML: elements without content, with raw text, that break blocks, and that no text is taken from.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form button select script style svg math canvas object audio video dialog menu search noscript template iframe".split())
MAIN = frozenset(("article", "main"))
#: Elements that an opening tag closes, if one is open within the nearest element of the second set; and the tags that close them.
SCOPES = (({"p"}, {"td", "th", "button", "table", "object"}), ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"}), ({"nav", "head"}, set()))
CLOSED_BY = {**{tag: (0,) for tag in BLOCK}, "li": (0, 1), "dt": (0, 2), "dd": (0, 2), "tr": (0, 3), "td": (0, 4), "th": (0, 4), "option": (0, 5), "article": (0, 6), "main": (0, 6)}
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar notice cookie cookies consent gdpr popup modal newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies form search pagination pager widget toolbar copyright".split())
#: Words that a noise class may have besides: "share-buttons" is noise, "share-price" is not.
GENERIC_WORDS = frozenset("area bar block box button buttons container group inner item items left link links list outer panel right section slot unit wrap wrapper".split())
OUTSIDE_NOISE = frozenset("header masthead".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@lru_cache(4096)
def _traits(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(name in paths, noise anywhere, noise outside the main content)."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = re.split(r"\s+", f"{found.get('class', '')} {found.get('id', '')}".strip().lower())
    words = {w for name in names for w in re.split(r"[-_]", name)}
    noise = tag in DROPPED or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    if tag not in MAIN and tag not in ("html", "body"):
        noise = noise or any(set(parts) & NOISE_WORDS and set(parts) <= NOISE_WORDS | GENERIC_WORDS for parts in (re.split(r"[-_]+", w) for w in names if w))
    label = ".".join(sorted(n for n in names if n and not re.search(r"\d", n)))
    return f"{tag}.{label}" if label else tag, noise, tag == "header" or bool(words & OUTSIDE_NOISE)


class Page:
    """The blocks of a page: (path, parent's path, dropped, inside main, text); and elements: path -> different child names.

    Paths are hashes, and each open element knows which open element a tag would close, so that
    time and memory are in proportion to the page, however deep it is nested.
    """

    __slots__ = ("blocks", "children")

    def __init__(self, source: str):
        self.blocks: list[tuple[int, int, bool, bool, str]] = []
        self.children: dict[int, dict[str, None]] = {}
        # an open element: tag, path, parent's path, dropped, inside main, places of what may be closed
        stack: list[tuple[str, int, int, bool, bool, tuple]] = [("", path_id(""), path_id(""), False, False, (0,) * len(SCOPES))]
        count: dict[str, int] = {}
        text: list[str] = []

        def flush() -> None:
            if text:
                whole = " ".join("".join(text).split())
                text.clear()
                if whole:
                    _, path, above, dropped, main, _ = stack[-1]
                    self.blocks.append((path, above, dropped, main, whole))

        def cut(size: int) -> None:
            for element in stack[size:]:
                count[element[0]] -= 1
            del stack[size:]

        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if not m:
                text.append(html.unescape(source[at:]))
                break
            if m.start() > at:
                text.append(html.unescape(source[at : m.start()]))
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "br":
                    text.append(" ")
                elif count.get(tag):
                    size = len(stack) - 1
                    while stack[size][0] != tag:
                        size -= 1
                    if any(e[0] in BLOCK for e in stack[size:]):
                        flush()
                    cut(size)
                elif tag in BLOCK:
                    flush()
                continue
            if tag in BLOCK:
                flush()
                for scope in CLOSED_BY[tag]:
                    if stack[-1][5][scope]:
                        cut(stack[-1][5][scope])
            elif tag == "br":
                text.append(" ")
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                at = n if end is None else (source.find(">", end.end()) + 1 or n)
                continue
            if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
                continue
            name, noise, outside = _traits(tag, m[3] or "")
            _, path, _, dropped, main, places = stack[-1]
            self.children.setdefault(path, {})[name] = None
            inside = main or (tag in MAIN and not dropped)
            dropped = dropped or noise or (outside and not main)
            if tag in _SCOPED:
                places = tuple(len(stack) if tag in names else 0 if tag in within else place for place, (names, within) in zip(places, SCOPES))
            stack.append((tag, path_id(name, path), path, dropped, inside and not dropped, places))
            count[tag] = count.get(tag, 0) + 1
        flush()

    def text(self, noise: set[int]) -> str:
        return "\n".join(t for path, _, dropped, _, t in self.blocks if not dropped and path not in noise)


_SCOPED = frozenset().union(*[names | within for names, within in SCOPES])


def path_id(name: str, above: int = 0) -> int:
    """A signed 64-bit hash of a name below a path."""
    return xxhash.xxh64_intdigest(name, above & (2**64 - 1)) - (1 << 63)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, path, parent, kind, value, content), once per page: 0 presence (value: inside main), 1 presentation, 2 text."""
    for batch in batches:
        hosts, rows = [], []
        for host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            page = Page(source or "")
            judged = [(path, above, main, text) for path, above, dropped, main, text in page.blocks if not dropped]
            content = path_id("\0".join(f"{path}\0{text}" for path, _, _, text in judged))
            styles, seen = {}, set()
            for path, above, main, text in judged:
                if above not in styles:
                    styles[above] = path_id(" ".join(page.children.get(above, ())))
                seen.add((path, above, 0, int(main), content))
                seen.add((above, 0, 1, styles[above], content))
                seen.add((path, above, 2, path_id(text), content))
            rows.extend(seen)
            hosts.extend([host] * len(seen))
        columns = list(zip(*rows)) if rows else [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]], ["host", "path", "parent", "kind", "value", "content"])


def style_tree(pages: DataFrame, copies: bool = True) -> DataFrame:
    """(host, path, m, importance): pages with a path and its composite importance, for each content path of a host's merged DOM.

    Unless `copies`, pages of a host that have equal blocks count as one.
    """
    rows = pages.select("host", "html").mapInArrow(_tree, "host string, path long, parent long, kind int, value long, content long")
    counts = written((rows if copies else rows.distinct()).groupBy("host", "path", "parent", "kind", "value").agg(F.count("*").alias("n")), "tree")
    presence = counts.where("kind = 0").select("host", "path", "parent", F.col("value").alias("main"), F.col("n").alias("m"))
    # a text on n of m pages has the entropy log n / log m, m counting the unseen pages too
    content = counts.where("kind = 2").groupBy("host", "path", "parent").agg(F.avg(F.log("n")).alias("repeated"))
    styles = counts.where("kind = 1").groupBy("host", "path").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("weighted"))
    # -sum p log p = log total - (sum n log n) / total; a single page's presentation counts in full
    style = styles.select("host", F.col("path").alias("parent"), F.when(F.col("total") > 1, (F.log("total") - F.col("weighted") / F.col("total")) / F.log("total")).otherwise(1.0).alias("style"))
    leaf = presence.join(content, ["host", "path", "parent"]).join(style, ["host", "parent"], "left")
    own = 1 - F.col("repeated") / F.log(F.col("m") + UNSEEN)
    tree = PRESENTATION * F.coalesce("style", F.lit(1.0)) + (1 - PRESENTATION) * own
    return leaf.select("host", "path", "m", (tree + MARKED * F.col("main") * (1 - tree)).alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source or "").text(set(noise or ())) for source, noise in zip(batch["html"].to_pylist(), batch["noise"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["own_page_id"], batch["own_url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["own_page_id", "own_url", "text", "n_chars"])


def html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null and empty pages give "". Blocks are joined by \\n; character references are decoded and
    white space inside a block is one space, as is <br>. A null url belongs to the host "". Every
    page gives what its host's style tree holds important and no tag, role or class calls noise.
    Copies of a page count once in the tree; repeated rows give equal texts, ties in importance are
    kept. Long and deeply nested pages take time in proportion. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").alias("own_page_id"), F.col("url").alias("own_url"), host.alias("host"), "html")
    tree = style_tree(rows, copies=False)
    noise = written(tree.where(F.col("importance") < THRESHOLD).groupBy("host").agg(F.collect_set("path").alias("noise")), "noise")
    kinds = dict(pages.dtypes)
    out = rows.join(noise, "host", "left").select("own_page_id", "own_url", "html", "noise").mapInArrow(_extract, f"own_page_id {kinds['page_id']}, own_url {kinds['url']}, text string, n_chars long")
    return out.select(F.col("own_page_id").alias("page_id"), F.col("own_url").alias("url"), "text", "n_chars")
