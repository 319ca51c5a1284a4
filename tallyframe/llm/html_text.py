"""Main text of web pages: page structure first, then removal of a site's templates.

Every element's subtree has a hash. Spark counts, per host, in how many pages of different content a
subtree occurs; recurring subtrees are template and go. What names itself as no content (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) goes by tag, role or class.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored
from tallyframe.operators.skew import attach


@dataclass(frozen=True)
class TemplateRule:
    """A subtree is template if it occurs in `share` of a host's pages of different content, and in
    `least_pages` of them at least. Prose blocks, tables and lists inside an article or main element are
    content however often they occur."""

    least_pages: int = 5
    share: float = 0.2


DEFAULT_RULE = TemplateRule()

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "head script style template noscript nav header footer aside form button select option textarea input label"
    " fieldset iframe object embed svg canvas audio video dialog menu title math map".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6"
    " hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption article main body html".split())
CONTAINERS = BLOCKS - PROSE
LISTED = frozenset("table ul ol dl".split())
CONTENT = frozenset(("article", "main"))
# which open elements a start tag ends, as far as the nearest element of the second set
IMPLIED = {
    **{t: (frozenset("p"), frozenset("table td th article section div body html".split())) for t in BLOCKS - {"body", "html"}},
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol"))),
    "dt": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "p")), frozenset(("table", "tbody", "thead", "tfoot"))),
    "td": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))),
}
# a class or id says so if it is made of these words, with words of place and shape or numbers beside them
NO_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies"
    " disqus footer header masthead menu modal nav navbar navigation newsletter notice notices alert consent gdpr pagination"
    " pager popup promo promotion related recommended replies respond share sharing sidebar side skip social sponsor sponsored"
    " subscribe subscription teaser toolbar widget login signup search".split()
)
BESIDE = frozenset(
    "site main page top bottom left right primary secondary global mobile desktop area bar block box button buttons container"
    " form icons item items link links list section to".split()
)
COMMENT = re.compile(r"(?:div[_-])?comments?(?:[_-](?:body|box|content|item|text|\d+))?")
NO_CONTENT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split()
)
MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[\s ]+")


# what drops an element, weakest first: a form may be around the whole page, a name may be that of a layout
FORM, NAMED, ALWAYS = 1, 2, 3
# where a block lies: in a form; nowhere special; in an article of a dropped element; in an article or main element
IN_FORM, PLAIN, RESCUED, CONTENTS = -1, 0, 1, 2


def names_no_content(names: str) -> bool:
    for name in names.lower().split():
        parts = [p for p in re.split("[_-]+", name) if p and not p.isdigit()]
        if not NO_CONTENT.isdisjoint(parts) and all(p in NO_CONTENT or p in BESIDE for p in parts):
            return True
    return False


class Node:
    """An open element: what of it is known so far."""

    __slots__ = ("tag", "dropped", "content", "names", "parts", "key", "listed")

    def __init__(self, tag: str, dropped: int, content: int, names: str, key: int, listed: bool = False) -> None:
        self.tag, self.dropped, self.content, self.names, self.key = tag, dropped, content, names, key
        self.listed = listed  # a table or list inside content, or in one
        self.parts: list[str] = []  # hashes and texts of the children, in order


class Page:
    """Blocks of text and subtrees of one page.

    `blocks`: (text, ids of the subtrees around it, where it lies), dropped ones left out but for those of
    forms. `subtrees`: (id, hash) of the subtrees whose recurrence would make them template.
    """

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, list[int], int]] = []
        self.subtrees: list[tuple[int, int]] = []
        self.text: list[str] = []
        self.count = 0
        self.stack = [Node("#root", 0, PLAIN, "", 0)]
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = MARKUP.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._add(m[0][9:-3])
                continue
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3] or "")
            if tag in RAW and tag not in VOID:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                self._add(source[at : close.start() if close else end])
                at = close.end() if close else end
                self._pop()
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _add(self, raw: str) -> None:
        top = self.stack[-1]
        text = html.unescape(raw) if "&" in raw and top.tag not in ("script", "style") else raw
        top.parts.append(text)
        if top.dropped <= FORM:
            self.text.append(text)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._add(" ")
            return
        ended, limit = IMPLIED.get(tag, (frozenset(), frozenset()))
        if ended:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in limit:
                    break
                if self.stack[k].tag in ended:
                    while len(self.stack) > k:
                        self._pop()
        if tag in VOID:
            if tag in BLOCKS:
                self._flush()
            return
        found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        parent, role = self.stack[-1], found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true"
        heart = tag in CONTENT or role == "main"
        comment = tag == "article" and any(COMMENT.fullmatch(n) for n in names.lower().split())
        own = 0
        if tag == "form" or role == "form":
            own = FORM
        elif tag in DROPPED or hidden or comment or role in NO_CONTENT_ROLES:
            own = ALWAYS
        # the page as a whole is no menu or advert, whatever its name
        if own < NAMED and tag not in ("html", "body") and not heart and names_no_content(names):
            own = NAMED
        if hidden:
            own = ALWAYS
        # an article or main element is not lost with a form or a named element around it
        within, content = parent.dropped, parent.content or (CONTENTS if heart else PLAIN)
        if heart and not own and within in (FORM, NAMED):
            content = RESCUED if within == NAMED and tag == "article" else CONTENTS
            within = 0
        dropped = max(within, own)
        if tag in BLOCKS or dropped != parent.dropped:
            self._flush()
        self.count += 1
        listed = parent.listed or parent.content and tag in LISTED
        self.stack.append(Node(tag, dropped, content, names.strip(), self.count, listed))

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in ("td", "th", "article", "main", "body") and tag not in BLOCKS and tag not in DROPPED:
                return  # a stray end tag of an inline element ends nothing outside
        if tag in ("p", "br"):
            self._flush()

    def _pop(self) -> None:
        node = self.stack[-1]
        if node.tag in BLOCKS or node.dropped != self.stack[-2].dropped:
            self._flush()
        self.stack.pop()
        body = SPACE.sub(" ", "".join(node.parts)).strip()
        name = xxhash.xxh64_intdigest(f"{node.tag}\0{node.names}\0{body}".encode("utf-8", "surrogatepass"))
        self.stack[-1].parts.append(f"\1{name:x}\2")
        # inside content only containers can be template, never the prose itself, nor a table or list
        inside = node.tag in CONTAINERS and not node.listed
        if node.dropped <= FORM and body and node.tag not in ("html", "body") and (not node.content or inside):
            self.subtrees.append((node.key, name - (1 << 64) if name >> 63 else name))

    def _flush(self) -> None:
        """End of a block: the text since the last one, under the elements open now."""
        text = SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            around = [n.key for n in self.stack[1:] if n.tag not in ("html", "body")]
            top = self.stack[-1]
            self.blocks.append((text, around, IN_FORM if top.dropped else top.content))

    def main(self) -> list[tuple[str, list[int]]]:
        """Blocks inside article or main elements if there are any, else all.

        Articles in elements dropped by name count only on pages without others and if they have more
        text than what is not dropped; text of forms only on pages without any other.
        """
        of = {k: [(t, ids) for t, ids, where in self.blocks if where == k] for k in (CONTENTS, RESCUED, PLAIN, IN_FORM)}
        length = {k: sum(len(t) for t, _ in blocks) for k, blocks in of.items()}
        if not of[CONTENTS] and length[RESCUED] > length[PLAIN]:
            return of[RESCUED]
        return of[CONTENTS] or of[PLAIN] or of[IN_FORM]


BLOCK_TYPE = "array<struct<text:string,around:array<long>>>"


def parsed(pages: DataFrame) -> DataFrame:
    """`page_id, url, host, blocks, subtrees, content`: `around` holds the hashes of the subtrees a block
    lies in, `content` a hash of all blocks."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))])
        for batch in batches:
            blocks, subtrees, content = [], [], []
            for source in batch.column("html"):
                page = Page(source.as_py() or "")
                hashes = dict(page.subtrees)
                main = page.main()
                blocks.append([{"text": t, "around": [hashes[k] for k in ids if k in hashes]} for t, ids in main])
                subtrees.append(sorted(set(hashes.values())))
                joined = "\n".join(t for t, _ in main).encode("utf-8", "surrogatepass")
                content.append(xxhash.xxh64_intdigest(joined) >> 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(blocks, pa.list_(around)),
                 pa.array(subtrees, pa.list_(pa.int64())), pa.array(content, pa.int64())],
                ["page_id", "url", "blocks", "subtrees", "content"],
            )

    rows = pages.select("page_id", "url", "html").mapInArrow(
        tasks, f"page_id {kind}, url string, blocks {BLOCK_TYPE}, subtrees array<long>, content long")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return rows.withColumn("host", host)


def main_texts(pages: DataFrame, rule: TemplateRule = DEFAULT_RULE) -> DataFrame:
    """`page_id, url, text, n_chars` per row of `pages`.

    Character references are decoded, white space inside a block is one space, blocks are trimmed, empty
    ones left out, and the rest joined by two line ends in page order. Inside article or main elements if
    the page has any with text, else in the whole page (`Page.main` has the order for pages whose content
    stands in a form or in an element whose name says no content). A null or empty html gives an empty text. Pages
    without a host (a null or relative url) share the empty host. Pages of equal content count once, so
    copies of a page make no template. Repeated rows each get their row, null ids stay, other columns are
    not read, and an empty table gives an empty one.
    """
    rows = parsed(pages.select(pages["page_id"], pages["url"], pages["html"]))
    rows = stored(rows.withColumn("_key", F.xxhash64("page_id", "url", "content")))
    # distinct contents per subtree: (host, subtree, content) combined within tasks before the shuffle;
    # the null subtree stands for the page, its count is that of the host's pages
    subtrees = F.concat(F.array(F.lit(None).cast("long")), "subtrees")
    seen = rows.select("host", "content", F.explode(subtrees).alias("subtree"))
    counts = seen.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    counts = stored(counts.filter((F.col("n") >= rule.least_pages) | F.col("subtree").isNull()))
    pages_of = counts.filter("subtree IS NULL").select("host", F.col("n").alias("pages"))
    often = attach(counts.filter("subtree IS NOT NULL"), pages_of, ["host"], how="inner")
    template = stored(often.filter(F.col("n") >= F.col("pages") * rule.share).select("host", "subtree"))
    # only subtrees around a block can change a text
    touched = rows.select("_key", "host", F.explode_outer(F.array_distinct(F.flatten("blocks.around"))).alias("subtree"))
    touched = touched.filter("subtree IS NOT NULL").distinct()
    gone = attach(touched, template, ["host", "subtree"], how="inner").groupBy("_key").agg(F.collect_set("subtree").alias("gone"))
    out = attach(rows.select("_key", "page_id", "url", "blocks"), stored(gone), ["_key"])
    left = F.filter("blocks", lambda b: F.coalesce(~F.arrays_overlap(b["around"], F.col("gone")), F.lit(True)))
    out = out.select("page_id", "url", F.array_join(F.transform(left, lambda b: b["text"]), "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
