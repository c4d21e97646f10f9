"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every text block of a page is a node that is content or not. A node's features are drawn given
its label, and a child's label given its parent's by a table for its kind (text block, or element by tag and whether it
is named); sum-product messages go up from the leaves and down from the root, once each, and give every text block's
exact marginal. The tables are
trained by counting over labelled pages, which a seeded generator lays out in many styles of site; no page of the
corpus is trained on.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
a line feed in page order. Scripts, styles, templates, form controls and markup are never text.

Defined results: a null or empty page, and a page without content, gives an empty text; broken markup is read as far as
it goes (unclosed elements end with their parent, stray end tags are passed over, an unclosed comment or script runs to
the end); pages of any length are read whole; repeated rows are separate; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import ship, table

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
#: Elements whose text is no text of the page.
SILENT = frozenset("script style template noscript head title textarea select option button svg math iframe object audio video canvas map datalist".split())
#: An opening tag ends these open elements, up to the bounds given.
_CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"]))}
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
_HEAD = re.compile(r"</?[a-zA-Z][^\s/><]*+")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TRAIN_PAGES, SEED = 800, 20_240
#: Kinds of node: text blocks, and elements that no labelled page holds; other elements by tag, and by whether class or id name them.
LEAF, ANY = "#text", "#any"


class _Ends:
    """Whether a tag that is open at a place of a page ends: from there, quotes are passed over to a closing bracket."""

    def __init__(self, source: str):
        self.at = [m.start() for m in re.finditer("[>\"']", source)]
        self.ok = [False] * (len(self.at) + 1)
        after: dict[str, int] = {}
        for k in range(len(self.at) - 1, -1, -1):
            c = source[self.at[k]]
            self.ok[k] = c == ">" or (c in after and self.ok[after[c] + 1])
            after[c] = k

    def closed(self, place: int) -> bool:
        return self.ok[bisect_left(self.at, place)]


class Page:
    """Nodes in page order: parent, features and kind of each, and the text of text blocks."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [[]]
        self.kind: list[str] = ["#root"]
        self.text: list[str | None] = [None]
        self.marks: list[str | None] = [None]
        self._read(source)

    def _node(self, parent: int, kind: str, features: list[str], text: str | None, mark: str | None) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.features.append(features)
        self.text.append(text)
        self.marks.append(mark)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # name, node, silent
        pieces: list[str] = []
        linked = total = links = 0

        def end_block() -> None:
            nonlocal linked, total
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    self._node(stack_node(), LEAF, leaf_features(text, linked / max(1, total)), text, None)
                linked = total = 0

        def stack_node() -> int:
            return stack[-1][1]

        def pop_to(k: int) -> None:
            nonlocal links
            if any(s[0] in BLOCKS for s in stack[k:]):
                end_block()
            links -= sum(s[0] == "a" for s in stack[k:])
            opened.subtract(s[0] for s in stack[k:])
            del stack[k:]

        at, size, opened, ends = 0, len(source), Counter(), None
        while at < size:
            if ends is not None and (head := _HEAD.match(source, at)) and not ends.closed(head.end()):
                m, at = _TOKEN.match("<"), at + 1
            else:
                m = _TOKEN.match(source, at)
                at = m.end()
            name = m.group(2)
            if m.group() == "<" and ends is None:
                ends = _Ends(source)  # a tag that never ends was read to the end of the page once, and no other is
            if name is None:
                piece = m.group()
                if piece[0] == "<" and len(piece) > 1 and piece[1] in "!?":
                    continue
                if not stack[-1][2]:
                    if "&" in piece:
                        piece = html.unescape(piece)
                    pieces.append(piece)
                    if piece.strip():
                        total += len(piece)
                        linked += len(piece) if links else 0
                continue
            name = name.lower()
            if m.group(1):
                if name == "br":
                    pieces.append(" ")
                elif name == "p" and not opened["p"]:
                    end_block()
                elif opened[name]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            pop_to(k)
                            break
                        if name not in BLOCKS and stack[k][0] in BLOCKS:
                            break
                continue
            block, silent = name in BLOCKS, stack[-1][2] or name in SILENT
            if name in _CLOSES:
                ended, bounds = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in bounds:
                        break
                    if stack[k][0] in ended:
                        pop_to(k)
                        break
            if block:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
                end_block()
                if name == "body":  # ends the head
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "head":
                            pop_to(k)
                            break
                silent = stack[-1][2] or name in SILENT
            elif name == "br":
                pieces.append(" ")
            if name in RAW:
                closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = closing.end() if closing else size
                continue
            if name in VOID or (m.group(3) or "").endswith("/") and not block and name not in SILENT:
                continue
            node = stack[-1][1]
            if block:
                found, mark = element_features(m.group(3) or "")
                node = self._node(node, f"{name} named" if found else name, found, None, mark)
            links += name == "a"
            opened[name] += 1
            stack.append((name, node, silent))
        end_block()


def element_features(attributes: str) -> tuple[list[str], str | None]:
    out, mark = [], None
    if attributes and ("=" in attributes):
        words: set[str] = set()
        for m in _ATTRIBUTE.finditer(attributes):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            words.update(w.lower() for w in _WORD.findall(value))
        out.extend(f"name:{w}" for w in sorted(words))
        if "data-label" in attributes:
            mark = "1" if 'data-label="1"' in attributes else "0"
    return out, mark


def leaf_features(text: str, linked: float) -> list[str]:
    # length, end marks and links go together in titles, menus and sentences alike, so they are one feature
    words = text.count(" ") + 1
    stops = sum(map(text.count, ".,;:!?"))
    shape = f"text:{min(5, words.bit_length())}:{min(2, stops)}:{0 if linked < 0.1 else 1 if linked < 0.5 else 2}"
    return [shape, "sign:1" if text[0] == "©" else "sign:0"]


class Model:
    """log odds of each feature, and the child-given-parent table of each kind of child."""

    def __init__(self, odds: dict[str, float], step: dict[str, list[list[float]]], prior: float):
        self.odds, self.step, self.prior = odds, step, prior

    def table(self, kind: str) -> list[list[float]]:
        return self.step.get(kind) or self.step[ANY]

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content: messages up, then down, in page order (parents come first)."""
        n, get = len(page.parent), self.odds.get
        one = [math.exp(max(-30.0, min(30.0, sum(get(f, 0.0) for f in fs)))) for fs in page.features]  # potential of 1 against 0
        tables = [self.table(k) for k in page.kind]
        up = [1.0] * n
        below = one[:]
        for i in range(n - 1, 0, -1):
            t = tables[i]
            b = below[i]
            up[i] = (t[1][0] + t[1][1] * b) / (t[0][0] + t[0][1] * b)
            p = page.parent[i]
            below[p] = min(1e60, max(1e-60, below[p] * up[i]))
        out = [0.0] * n
        odds = below[0] * self.prior / (1 - self.prior)
        out[0] = odds / (1 + odds)
        for i in range(1, n):
            t, p = tables[i], out[page.parent[i]]
            # the parent's belief without what this child said of it
            q1, q0 = p / up[i], 1 - p
            a1, a0 = q1 * t[1][1] + q0 * t[0][1], q1 * t[1][0] + q0 * t[0][0]
            b = below[i] * a1
            out[i] = b / (b + a0) if b + a0 > 0 else 0.5
        return out


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = Page(source)
    p = model.marginals(page)
    return "\n".join(t for t, x in zip(page.text, p, strict=True) if t is not None and x > 0.5)


# --- labelled pages ---

_GOOD_NAMES = "article content post entry main story body text page blog prose hentry single markdown documentation news detail rich copy".split()
_BAD_NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav subnav tabs links sitemap".split(), "header": "header masthead topbar banner brand logo site hero head top".split(), "footer": "footer copyright legal colophon bottom foot credits".split(),
    "aside": "sidebar aside widget rail related recommended trending popular archive tags secondary complementary more".split(), "ad": "ad ads advert advertisement sponsored sponsor promo promotion dfp adsense partner commercial".split(), "notice": "cookie consent gdpr notice notification alert popup modal overlay banner privacy message disclaimer paywall".split(),
    "form": "form newsletter subscribe signup login search contact optin".split(), "comments": "comments comment respond reply replies disqus thread discussion commentlist feedback responses".split(), "share": "share sharing social buttons toolbar follow print meta byline pagination pager tools".split(),
}
_NEUTRAL = "container wrapper row col inner clearfix left right block box grid outer wrap layout center column main site lg md flex".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 20))

    def words(self, n: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(self.letters) for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize()

    def sentence(self, n: int) -> str:
        return self.words(n) + self.rng.choice("....!?")

    def paragraph(self) -> str:
        r = self.rng
        if r.random() < 0.2:  # text without an end mark
            return self.words(r.choice((1, 2, 4, 8, 15)))
        out = []
        for _ in range(r.choice((1, 1, 1, 2, 4, 8))):
            s = self.sentence(r.choice((1, 2, 3, 7, 12, 20)))
            out.append(s if r.random() > 0.15 else f'<a href="/x">{s}</a>' if r.random() < 0.3 else f"<b>{s}</b>")
        return " ".join(out)

    def names(self, pool: list[str], sure: float = 0.8) -> str:
        r = self.rng
        out = [r.choice(pool)] if r.random() < sure else []
        out += r.sample(_NEUTRAL, r.choice((0, 0, 1, 2)))
        if not out:
            return ""
        r.shuffle(out)
        return f' {r.choice(("class", "class", "id"))}="{r.choice((" ", "-", "_")).join(out)}"'

    def element(self, name: str, attributes: str, label: int, inner: str) -> str:
        end = "" if name in ("p", "li") and self.rng.random() < 0.15 else f"</{name}>"
        return f'<{name}{attributes} data-label="{label}">{inner}{end}'

    def links(self, n: int, label: int = 0) -> str:
        r = self.rng
        item = lambda: f'<a href="/x">{self.words(r.randint(1, 4))}</a>'
        if r.random() < 0.6:
            return self.element("ul", "", label, "".join(self.element("li", "", label, item()) for _ in range(n)))
        return r.choice((" ", " | ", " &middot; ")).join(item() for _ in range(n))

    def bad(self, kind: str) -> str:
        r = self.rng
        e = lambda name, inner, attributes="": self.element(name, attributes, 0, inner)
        tag = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "p"), "notice": ("div", "section", "p", "dialog"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul", "p")}[kind]
        name = r.choice(tag)
        inner = []
        if kind == "nav":
            inner = [self.links(r.randint(3, 9))]
        elif kind == "header":
            inner = [r.choice((self.words(2), e("h1", self.words(2)), e("p", self.sentence(6)))), self.links(r.randint(0, 4)), r.choice(("", e("nav", self.links(5))))]
        elif kind == "footer":
            inner = [f"&copy; {self.words(2)} &middot; {self.sentence(r.randint(2, 14))}", r.choice(("", self.links(4))), r.choice(("", e("p", self.paragraph())))]
        elif kind == "aside":
            inner = [e(r.choice(("h2", "h3", "h4")), self.words(2)), r.choice((self.links(r.randint(3, 8)), e("p", self.paragraph()), e("p", self.sentence(8))))]
        elif kind == "ad":
            inner = [r.choice((self.sentence(r.randint(3, 15)), self.paragraph(), e("p", self.paragraph()), f'<a href="/x">{self.words(4)}</a>'))]
        elif kind == "notice":
            inner = [r.choice((self.sentence(r.randint(5, 25)), e("p", self.paragraph()))), r.choice(("", "<button>OK</button>"))]
        elif kind == "form":
            inner = [r.choice((e("p", self.sentence(7)), e("h3", self.words(3)), "<label>Mail</label>")), '<input type="text">', r.choice(("", e("p", self.paragraph())))]
        elif kind == "comments":
            inner = [e(r.choice(("h2", "h3")), self.words(1))]
            for _ in range(r.randint(1, 6)):
                inner.append(e(r.choice(("div", "li", "article")), r.choice(("", self.words(1))) + e("p", self.paragraph()), self.names(_BAD_NAMES["comments"])))
        else:
            inner = [r.choice((self.links(r.randint(2, 5)), self.words(4)))]
        if name == "p":  # holds no blocks
            inner = [re.sub(r"</?(?:p|ul|li|h\d)\b[^>]*>", " ", x) for x in inner]
        sure = 0.55 if name in ("nav", "footer", "aside", "header", "form") else 1.0
        return self.element(name, self.names(_BAD_NAMES[kind], sure), 0, "".join(inner))

    def good(self) -> str:
        r = self.rng
        e = lambda name, inner: self.element(name, self.names(_GOOD_NAMES, 0.1) if r.random() < 0.2 else "", 1, inner)
        out = [e("h1", self.words(r.randint(3, 12)))]
        if r.random() < 0.2:
            out = [self.element("header", "", 1, out[0] + self.element("p", self.names(_BAD_NAMES["share"], 1.0), 0, self.words(3)))]
        for _ in range(r.choice((1, 2, 5, 9, 20))):
            x = r.random()
            if x < 0.64:
                out.append(e("p", self.paragraph()))
            elif x < 0.71:
                out.append(e(r.choice(("h2", "h3", "h4")), self.words(r.randint(1, 6))))
            elif x < 0.86:
                out.append(e(r.choice(("ul", "ol")), "".join(e("li", self.paragraph()) for _ in range(r.randint(2, 6)))))
            elif x < 0.9:
                out.append(e("blockquote", e("p", self.paragraph())))
            elif x < 0.92:
                out.append(e("table", e("tr", "".join(e("td", self.words(2)) for _ in range(4)))))
            elif x < 0.94:
                out.append(e("pre", self.words(20)))
            elif x < 0.96:
                out.append(e("figure", e("figcaption", self.sentence(8))))
            else:
                out.append(self.bad(r.choice(("ad", "share", "aside", "form"))))
        inner = "".join(out)
        for _ in range(r.choice((0, 0, 0, 1))):
            inner = self.element("div", self.names(_GOOD_NAMES, 0.5), 1, inner)
        name = r.choice(("article", "article", "div", "main", "section", "td"))
        body = self.element(name, self.names(_GOOD_NAMES, 0.4 if name in ("article", "main") else 0.95), 1, inner)
        return self.element("table", "", 1, self.element("tr", "", 1, body)) if name == "td" else body

    def page(self) -> str:
        r = self.rng
        before = [self.bad(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.5]
        after = [self.bad(k) for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if r.random() < 0.5]
        r.shuffle(before)
        middle = self.good()
        if r.random() < 0.5:
            middle = self.element(r.choice(("div", "main", "section")), self.names(_GOOD_NAMES, 0.3), 1, middle + "".join(self.bad(k) for k in ("aside", "comments") if r.random() < 0.3))
        body = "".join(before) + middle + "".join(after)
        if r.random() < 0.5:
            body = self.element("div", self.names(_NEUTRAL), 1, body)
        return f'<!DOCTYPE html><html data-label="1"><head><title>{self.words(4)}</title><style>p{{}}</style></head><body data-label="1">{body}</body></html>'


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Generated pages; data-label tells whether an element (and text that stands in it) is content."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]


def labels_of(page: Page) -> list[int]:
    out = [1]
    for i in range(1, len(page.parent)):
        out.append(int(page.marks[i]) if page.marks[i] is not None else out[page.parent[i]])
    return out


def train(pages: list[str]) -> Model:
    """Counts over labelled pages; features are smoothed by one, tables by those of all elements."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    total: tuple[Counter, Counter] = (Counter(), Counter())
    steps: Counter = Counter()
    for source in pages:
        page = Page(source)
        y = labels_of(page)
        for i in range(1, len(y)):
            leaf = page.kind[i] == LEAF
            steps[page.kind[i], y[page.parent[i]], y[i]] += 1
            if not leaf:
                steps[ANY, y[page.parent[i]], y[i]] += 1
            total[y[i]][leaf] += 1
            for f in page.features[i]:
                seen[y[i]][f] += 1
    odds = {}
    for f in sorted(seen[0].keys() | seen[1].keys()):
        leaf = not f.startswith("name:")
        odds[f] = math.log((seen[1][f] + 1) / (total[1][leaf] + 2)) - math.log((seen[0][f] + 1) / (total[0][leaf] + 2))
    share = lambda kind, x, weight, of: [(steps[kind, x, k] + weight * of[k]) / (steps[kind, x, 0] + steps[kind, x, 1] + weight) for k in (0, 1)]
    every = [share(ANY, x, 2, (0.5, 0.5)) for x in (0, 1)]
    step = {kind: [share(kind, x, 2, every[x]) for x in (0, 1)] for kind in sorted({k for k, _, _ in steps})}
    return Model(odds, step | {ANY: every}, 0.9)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
