"""Main-text extraction by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word's score is a sum of log odds: of the block it stands in, whether it is a
link, how long its block is and how much of that is links, whether the page's own article element holds it, and what its
container calls itself; tags score negative. The weights are learned from labelled pages, which are pages whose markup
names the article (article, main). One linear scan finds the contiguous region with the largest sum.

Of the region, what markup says is never content goes (scripts, styles, forms, menus, footers, hidden parts). A container
that names itself an advert, a notice, comments and the like has a negative weight for its words: its blocks go where
their sum is negative, which a clear name brings about anywhere and a vague one (related, legal, share) only where the
rest doesn't look like an article.

A page is read once from left to right, so the work grows with its length whatever it holds.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are learned from at most (about; chosen by a hash of the page's id).
SAMPLE_PAGES = 4000

#: Elements whose content is not text of the page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "option", "button", "datalist", "noframes", "xmp"}
#: Elements that end a block.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are never part of an article.
NEVER = {"nav", "aside", "footer", "form", "menu", "dialog", "head"}
#: Words of class, id or role by which a container says what it is; and those that say it less clearly.
CLEAR = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "toolbar", "pagination", "pager", "sitemap", "sidebar", "footer", "contentinfo", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe",
    "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "replies",
}
VAGUE = {
    "promo", "promotion", "promoted", "banner", "tabs", "skip", "aside", "related", "recommended", "recommendations", "trending", "widget", "widgets", "teaser", "share", "sharing", "social",
    "copyright", "legal", "disclaimer", "colophon", "complementary", "masthead", "notice", "notices", "alert", "subscription", "reply", "discussion",
}
_CONTENT = {"article", "main"}

_NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
_TO_QUOTE = re.compile(r"""[^>"']*""")
_CLOSE = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
_NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

#: Weights of places that no labelled page shows, in the same units (natural logarithm of odds), and how many words they count as.
PRIOR = {
    "w:p": 1.0, "w:h1": 0.8, "w:h2": 0.6, "w:h3": 0.5, "w:blockquote": 0.8, "w:pre": 0.6, "l:0": -0.6, "l:1": -0.3, "l:3": 0.4, "l:4": 0.8, "k:0": 0.3, "k:1": -0.5, "k:2": -2.0,
    "c:in": 3.0, "c:out": -3.0, "n:clear": -30.0, "n:vague": -2.5, "base": 0.2,
}
PRIOR_LINK, PRIOR_TAG, PRIOR_WEIGHT, MOST = -1.0, -0.3, 5.0, 4.0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", ""), ("", tag, attributes) or ("", /tag, ""), from left to right; comments and declarations are left out.

    An end that is missing is looked for once: from then on the page is known to have none.
    """
    at, size, quotes = 0, len(page), True
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        i = page.find(what, start)
        if i < 0:
            missing.add(what)
        return i

    while at < size:
        less = find("<", at)
        if less < 0:
            yield page[at:], "", ""
            return
        m = _NAME.match(page, less + 1)
        mark = page[less + 1 : less + 2]
        if not m and mark not in ("!", "?"):
            yield page[at : less + 1], "", ""  # a sign, not a tag
            at = less + 1
            continue
        if less > at:
            yield page[at:less], "", ""
        if not m:
            ends = "-->" if page.startswith("<!--", less) else "]]>" if page.startswith("<![CDATA[", less) else ">"
            i = find(ends, less + 2)
            at = size if i < 0 else i + len(ends)
            continue
        i = m.end()
        while True:
            i = _TO_QUOTE.match(page, i).end() if quotes else find(">", i)
            if i < 0 or i >= size:
                if quotes:  # a quotation mark or the tag has no end: read tags without regard to quotation marks from here on
                    quotes, i = False, m.end()
                    continue
                return
            if page[i] == ">":
                break
            close = page.find(page[i], i + 1)
            if close < 0:
                quotes, i = False, m.end()
            else:
                i = close + 1
        yield "", m[0].lower(), page[m.end() : i]
        at = i + 1
        if m[0].lower() in RAW and not page[m.end() : i].endswith("/"):
            end = _CLOSE[m[0].lower()].search(page, at)
            at = end.start() if end else size


def _named(attributes: str) -> str:
    """What class, id and role say: clear, vague, content, or nothing."""
    found = ""
    for m in _NAMING.finditer(attributes):
        said = (m[1] or m[2] or m[3] or "").lower()
        if m[0].lower().startswith("role") and said.strip() in _CONTENT:
            return "content"
        for word in re.split(r"[^a-z0-9]+", said):
            if word in CLEAR:
                return "clear"
            if word in VAGUE:
                found = "vague"
    return found


class _Open:
    """An open element and what holds for text in it."""

    __slots__ = ("tag", "block", "links", "named", "dropped", "content", "paragraph")

    def __init__(self, tag: str, above: _Open | None, attributes: str = ""):
        self.tag = tag
        self.block, self.links, self.named, self.dropped, self.content, self.paragraph = (above.block, above.links, above.named, above.dropped, above.content, above.paragraph) if above else ("", 0, "", False, 0, False)
        if tag in BLOCKS:
            self.block, self.paragraph = tag, tag == "p"
        self.links += tag == "a"
        says = _named(attributes) if attributes and tag not in ("html", "body") else ""
        if tag in _CONTENT or says == "content":
            self.content += 1
            if tag in _CONTENT:
                says = ""  # the article itself, whatever it is called
        if says in ("clear", "vague") and self.named != "clear":
            self.named = says
        self.dropped = self.dropped or tag in NEVER or tag == "header" and not self.content or bool(attributes and _HIDDEN.search(attributes))


def items(page: str) -> list[tuple[str, str, bool, int, str, str, int]]:
    """The page as (kind, key, dropped, in the article element, name, text, block): kind "t" for a run of text, "b" for a tag that ends a block, "i" for another tag."""
    top = _Open("", None)
    stack, open_tags, out, block = [top], Counter(), [], 0
    for text, tag, attributes in tokens(page):
        here = stack[-1]
        if text:
            out.append(("t", here.block + ("/a" if here.links else ""), here.dropped, here.content, here.named, text, block))
            continue
        ends = tag[0] == "/"
        name = tag[1:] if ends else tag
        if ends:
            if name in RAW and not open_tags[name]:
                continue
            if open_tags[name]:
                while len(stack) > 1:
                    gone = stack.pop()
                    open_tags[gone.tag] -= 1
                    if gone.tag == name:
                        break
        elif name in RAW:
            out.append(("i", f"<{name}", True, here.content, here.named, "", block))
            continue
        elif name not in VOID and not attributes.endswith("/"):
            if name in BLOCKS and here.paragraph:  # a new block ends an open paragraph
                while True:
                    gone = stack.pop()
                    open_tags[gone.tag] -= 1
                    if gone.tag == "p":
                        break
            stack.append(_Open(name, stack[-1], attributes))
            open_tags[name] += 1
        here = stack[-1]
        block += name in BLOCKS
        out.append(("b" if name in BLOCKS else "i", ("</" if ends else "<") + name, here.dropped, here.content, here.named, " " if name == "br" else "", block))
    return out


def is_labelled(page: str) -> bool:
    return bool(re.search(r"<(?:article|main)[\s>]", page, re.IGNORECASE))


def _scored(seq: list[tuple]) -> Iterator[tuple[int, int, list[str]]]:
    """(place in seq, number of words, features) of the runs of text that have words and aren't dropped."""
    words, links = Counter(), Counter()
    counts = [len(text.split()) if kind == "t" and not dropped else 0 for kind, _, dropped, _, _, text, _ in seq]
    for n, (_, key, _, _, _, _, block) in zip(counts, seq, strict=True):
        words[block] += n
        links[block] += n if key.endswith("/a") else 0
    holds = any(x[3] for x in seq)
    for i, (n, (_, key, _, content, name, _, block)) in enumerate(zip(counts, seq, strict=True)):
        if n:
            total, share = words[block], links[block] / words[block]
            length = 0 if total < 3 else 1 if total < 8 else 2 if total < 20 else 3 if total < 50 else 4
            own = [f"w:{key}", f"l:{length}", f"k:{0 if not share else 1 if share < 0.5 else 2}"]
            if holds:
                own.append("c:in" if content else "c:out")
            if name:
                own.append(f"n:{name}")
            yield i, n, own


def count_places(page: str) -> Counter:
    """(feature, inside) -> number of words or tags, of a labelled page. Inside is the article element, without what names itself clearly."""
    n: Counter = Counter()
    seq = items(page)
    for i, words, own in _scored(seq):
        inside = seq[i][3] > 0 and seq[i][4] != "clear"
        n[("base", inside)] += words
        for key in own:
            n[(key, inside)] += words
    for kind, key, dropped, content, _, _, _ in seq:
        if kind != "t":
            n[(f"t:{key}", content > 0 and not dropped)] += 1
    return n


def _prior(key: str) -> float:
    return PRIOR_LINK if key.endswith("/a") else PRIOR.get(key, 0.0)


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of content for every feature beyond those of any word ("base"), shrunk to the prior; tags are negative.

    Names keep their prior: what is labelled can't show an advert inside an article.
    """
    odds = lambda k: math.log((counts.get((k, True), 0) + 1) / (counts.get((k, False), 0) + 1))
    n = lambda k: counts.get((k, True), 0) + counts.get((k, False), 0)
    base = max(-1.0, min(1.0, odds("base"))) if n("base") else PRIOR["base"]
    out = {"base": base}
    for key in {k for k, _ in counts} - {"base"}:
        share = n(key) / (n(key) + PRIOR_WEIGHT)
        if key.startswith("t:"):
            out[key] = -0.02 - 0.5 / (1 + math.exp(odds(key) * share))
        elif not key.startswith("n:"):
            out[key] = share * max(-MOST, min(MOST, odds(key) - odds("base"))) + (1 - share) * _prior(key)
    return out


def extract(page: str, learned: dict[str, float]) -> str:
    """The main text: blocks joined by a line end, white space in a block as one space; empty if no region scores above 0.

    Of regions with equal sums the first one is taken.
    """
    if not page:
        return ""
    seq = items(page)
    value = lambda k: learned[k] if k in learned else _prior(k)
    scores = [-0.01 if x[2] else 0.0 if x[0] == "t" else learned.get(f"t:{x[1]}", PRIOR_TAG) for x in seq]
    base, named = learned.get("base", PRIOR["base"]), Counter()
    for i, n, own in _scored(seq):
        scores[i] = n * (base + sum(map(value, own)))
        if seq[i][4]:
            named[seq[i][6]] += scores[i]
    gone = {block for block, total in named.items() if total < 0}
    best = total = 0.0
    start, region = 0, None
    for i, score in enumerate(scores):
        if seq[i][4] and seq[i][6] in gone:
            score = -0.01  # it isn't text of the region anyway, and must not cut an article in two
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    if region is None:
        return ""
    blocks, held = [], []
    for kind, _, dropped, _, name, text, block in seq[region[0] : region[1]]:
        if kind == "b":
            blocks.append(held)
            held = []
        elif text and not dropped and not (name and block in gone):
            held.append(text)
    blocks.append(held)
    said = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in said if x)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from about `most` labelled pages. What comes to the driver is a count for each feature; elements bound their number."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html"))
    labelled = rows.filter(F.col("html").rlike(r"(?i)<(?:article|main)[\s>]"))
    n = labelled.count()
    if n > most:
        labelled = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(1).to_pylist():
                total.update(count_places(page))
        kinds = {"key": pa.string(), "inside": pa.bool_(), "n": pa.int64()}
        columns = zip(*((k, i, v) for (k, i), v in total.items()), strict=True) if total else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    sums = labelled.mapInArrow(counted, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["key"], r["inside"]): r["n"] for r in sums.collect()})


def extract_main(pages: DataFrame, learned: dict[str, float]) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty html gives an empty text; so does a page without content. Very long pages are read whole, once.
    Repeated rows and null ids are rows of their own. An empty table gives no rows; other columns are ignored.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x or "", learned) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
