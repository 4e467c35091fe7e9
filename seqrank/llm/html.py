"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrank.llm.boosting import Trees, fit
from seqrank.llm.common import first_by_hash

#: Pages whose texts the training pages are made of, and training pages for each.
SAMPLE, VARIANTS = 150, 6

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: A new element of these closes an open one of those, unless a list or table that it belongs to comes first.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset({"table", "td", "th", "caption"})

GROUPS = ("article main", "nav menu", "header hgroup", "footer", "aside", "form fieldset button select option label dialog input", "p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd", "div section", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption details summary address", "html body")
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags.split()}

#: Tokens of class, id and role, by what they say about an element.
TOKENS = (
    "nav menu menus navbar navigation breadcrumb breadcrumbs tabs pagination pager toc links",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense",
    "comment comments commentlist reply replies respond disqus discussion responses reader readers",
    "notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter paywall disclaimer legal warning",
    "sidebar side aside complementary widget related recommended trending popular rail",
    "header footer masthead topbar foot head copyright colophon bottom contentinfo site",
    "share sharing social follow form search login signup signin",
    "article content main post entry story body text prose",
)
_TOKEN = {token: 1 << i for i, tokens in enumerate(TOKENS) for token in tokens.split()}
HIDDEN = 1 << len(TOKENS)

# No alternative begins like another and none gives back what it took: a look at one place takes time in proportion to what it reads.
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)>|!--(?:>|->|.*?(?:--!?>|$))|[!?][^>]*+(?:>|$)|/[^a-zA-Z][^>]*+(?:>|$))", re.DOTALL)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_STARTS_TAG = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS: dict[str, int] = {}


def marks(attributes: str) -> int:
    """A bit for each group of TOKENS among an element's class, id and role, and HIDDEN."""
    if not attributes:
        return 0
    known = _MARKS.get(attributes)
    if known is None:
        known = 0
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                for w in _WORD.findall(value):
                    known |= _TOKEN.get(w.lower(), 0)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                known |= HIDDEN
        if len(_MARKS) > 100_000:
            _MARKS.clear()
        if len(attributes) < 500:
            _MARKS[attributes] = known
    return known


@dataclass
class Dom:
    """The elements of one or more pages in page order, in columns; ``text`` holds (element, piece) and None at block breaks."""

    tag: list[str] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # one past the last descendant
    label: list[int] = field(default_factory=list)  # what training pages say: 1 main, 0 not, -1 open
    text: list = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # code points of link text right inside
    fields: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)  # first element of every page

    def read(self, source: str) -> None:
        """Add a page, in time that grows in proportion to it. Elements that may be left open or closed early are treated as browsers do.

        An attribute's quote that never ends is none, from there to the end of the page; what opens a tag without
        any ``>`` behind it is text.
        """
        first = len(self.tag)
        self.page.append(first)
        self._open("html", "", -1, 0)
        stack, links = [first], 0
        inline: Counter[str] = Counter()  # open inline elements that are no nodes
        places: dict[str, list[int]] = {}  # where in the stack the elements of a name are open
        at = seek = 0
        quotes = True
        length = len(source)

        def text(piece: str) -> None:
            if piece:
                piece = entities.unescape(piece) if "&" in piece else piece
                self.text.append((stack[-1], piece))
                if inline["a"]:
                    self.links[stack[-1]] += len(piece.strip())

        def pop(to: int) -> None:
            """Close elements until ``to`` are open."""
            while len(stack) > to:
                closed = stack.pop()
                if stack:
                    places[self.tag[closed]].pop()
                self.end[closed] = len(self.tag)
                if self.tag[closed] not in INLINE:
                    self.text.append(None)

        def find(tags, stops) -> int:
            """Where the innermost open element of ``tags`` is, if none of ``stops`` is open inside it."""
            k = max((places[t][-1] for t in tags if places.get(t)), default=-1)
            return k if k > 0 and k > max((places[t][-1] for t in stops if t not in tags and places.get(t)), default=-1) else -1

        while at < length:
            start = source.find("<", seek)
            if start < 0:
                text(source[at:])
                break
            m = (_TAG if quotes else _LOOSE_TAG).match(source, start)
            if m is None and not quotes:
                m = None if _STARTS_TAG.match(source, start) else _TAG.match(source, start)
            elif m is None and _STARTS_TAG.match(source, start):
                quotes = False
                m = _LOOSE_TAG.match(source, start)
            if m is None:
                if _STARTS_TAG.match(source, start):
                    text(source[at:])
                    break
                seek = start + 1
                continue
            text(source[at:start])
            at = seek = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:  # an end tag
                if name in INLINE:
                    if inline[name]:
                        inline[name] -= 1
                    elif (k := find({name}, CLOSES_P | SCOPE)) > 0:
                        pop(k)
                elif name == "br":
                    self.text.append(None)
                elif name not in ("html", "body") and (k := find({name}, SCOPE - {name} if name not in ("tr", "tbody", "thead", "tfoot", "td", "th") else {"table"})) > 0:
                    pop(k)
                    inline.clear()
                continue
            attributes = m[3]
            if name in RAW:
                if not attributes.rstrip().endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}\s*/?>", re.IGNORECASE).search(source, at)
                    at = seek = stop.end() if stop else length
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.text.append(None)
                elif name == "input":
                    self.fields[stack[-1]] += 1
                continue
            if name in ("html", "head"):
                continue
            if name == "body":
                if len(stack) > 1:
                    continue
            elif name in CLOSES_P and (k := find({"p"}, SCOPE | {"button"})) > 0:
                pop(k)
                inline.clear()
            if name in SIBLINGS and (k := find(*SIBLINGS[name])) > 0:
                pop(k)
                inline.clear()
            if name in INLINE and not (mark := marks(attributes)):
                inline[name] += 1
                continue
            if name in INLINE:
                if name == "a":
                    inline[name] += 1
                    continue
            else:
                self.text.append(None)
                inline.clear()
                if name in ("button", "select"):
                    self.fields[stack[-1]] += 1
            places.setdefault(name, []).append(len(stack))
            stack.append(self._open(name, attributes, stack[-1], len(stack)))
        pop(0)

    def _open(self, tag: str, attributes: str, parent: int, depth: int) -> int:
        self.tag.append(tag)
        self.mark.append(marks(attributes))
        self.parent.append(parent)
        self.depth.append(depth)
        self.end.append(0)
        self.links.append(0)
        self.fields.append(0)
        m = re.search(r'data-main="([01])"', attributes) if "data-main" in attributes else None
        self.label.append(int(m[1]) if m else -1)
        return len(self.tag) - 1

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """A row of numbers for every element, and its length of text with all descendants."""
        n = len(self.tag)
        parent, end = np.array(self.parent), np.array(self.end)
        page = np.repeat(self.page, np.diff([*self.page, n]))
        own, stops = np.zeros(n), np.zeros(n)
        starts = np.full(n, -1.0)
        seen = 0
        for item in self.text:
            if item:
                node, piece = item
                size = len(piece.strip())
                if starts[node] < 0:
                    starts[node] = seen
                own[node] += size
                seen += size
                stops[node] += piece.count(".") + piece.count(",")

        def below(values):
            total = np.concatenate([[0.0], np.cumsum(values)])
            return total[end] - total[:-1]

        group = np.array([_GROUP.get(t, len(GROUPS)) for t in self.tag])
        tags = (group[:, None] == np.arange(len(GROUPS))).astype(float)
        mark = (np.array(self.mark)[:, None] >> np.arange(len(TOKENS) + 1)) & 1
        up = np.zeros((n, mark.shape[1] + 6))
        six = tags[:, [0, 1, 2, 3, 4, 5]]
        flags = np.concatenate([mark, six], axis=1)
        depth = np.array(self.depth)
        by_depth = np.argsort(depth, kind="stable")
        for at in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[1:]:
            at = at[parent[at] >= 0]
            up[at] = np.maximum(up[parent[at]], flags[parent[at]])
        text, links = below(own), below(np.array(self.links, dtype=float))
        whole = np.maximum(text[page], 1)
        count = end - np.arange(n)
        # text before the element, over the page's
        before = np.concatenate([[0.0], np.cumsum(own)])[:-1]
        before = (before - before[page]) / whole
        root = parent < 0
        key = np.where(root, 0, parent)
        siblings = np.bincount(key[~root], minlength=n)[key]
        sibling_text = np.bincount(key[~root], text[~root], n)[key]
        rank = np.zeros(n)
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        same = np.unique(key * 64 + group, return_inverse=True)[1]
        alike = np.bincount(same)[same]
        mean = sibling_text / np.maximum(siblings, 1)
        columns = [
            depth, np.log1p(text), links / np.maximum(text, 1), text / whole, np.log1p(count), np.log1p(text / count), stops_share(below(stops), text), np.log1p(siblings), rank / np.maximum(siblings, 1),
            np.log1p(mean), np.log1p(text) - np.log1p(mean), alike / np.maximum(siblings, 1), before, before + text / whole, np.log1p(below(tags[:, 6])), np.log1p(below(np.array(self.fields, dtype=float))),
            below(tags[:, 0]) > tags[:, 0], below(np.array([t == "h1" for t in self.tag], dtype=float)) > 0, own / np.maximum(text, 1), np.array([t == "h1" for t in self.tag]),
        ]
        return np.concatenate([tags, mark, up, np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)], axis=1), text

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """The likeliest consistent choice: an element that is left out leaves out all that it holds.

        A root is kept. With log-odds m of every element, keeping one is worth m and leaving it out -m;
        from the leaves up, the better of the two is known for every subtree.
        """
        n = len(self.tag)
        keep, drop = margin.tolist(), (-margin).tolist()
        best = [0.0] * n
        for i in range(n - 1, -1, -1):
            best[i] = max(keep[i], drop[i])
            p = self.parent[i]
            if p >= 0:
                keep[p] += best[i]
                drop[p] += drop[i]
        out = np.ones(n, dtype=bool)
        for i in range(n):
            p = self.parent[i]
            out[i] = p < 0 or (out[p] and keep[i] >= drop[i])
        return out

    def main_text(self, kept: np.ndarray) -> list[str]:
        """The text of each page: blocks of what is kept, white space as single spaces, joined by one space."""
        out, blocks, block, page = [], [], [], 0
        ends = [*self.page[1:], len(self.tag)]

        def close():
            joined = " ".join("".join(block).split())
            block.clear()
            if joined:
                blocks.append(joined)

        for item in self.text:
            if item is None:
                close()
                continue
            node, piece = item
            while node >= ends[page]:
                close()
                out.append(" ".join(blocks))
                blocks, page = [], page + 1
            if kept[node]:
                block.append(piece)
        close()
        out.append(" ".join(blocks))
        return out + [""] * (len(self.page) - len(out))


def stops_share(stops: np.ndarray, text: np.ndarray) -> np.ndarray:
    return stops / np.maximum(text, 1)


def training_page(rng: random.Random, texts: list[str], short: list[str]) -> str:
    """A page in one of many layouts, around ``texts``; ``data-main`` says what belongs to the article."""

    def some(*choices):
        return rng.choice(choices)

    def chance(p):
        return rng.random() < p

    def words(a, b):
        return " ".join(rng.choice(short) for _ in range(rng.randint(a, b)))

    def links(n):
        items = [f'<a href="/{i}">{words(1, 3)}</a>' for i in range(n)]
        kind = some("ul", "ul", "div", "p", "span")
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<{kind}>{x}</{kind}> " for x in items)

    def paragraph():
        return rng.choice(texts)

    def off(tags, names, inner, plain=0.15):
        """Something that isn't the article, with a telling tag or a telling class."""
        tag = some(*tags)
        bare = tag in ("div", "section", "ul", "p") and not chance(plain)
        name = f' {some("class", "class", "id")}="{some(*names)}{some("", "", "-box", "_1", " wide")}"' if bare or chance(0.4) else ""
        return f'<{tag} data-main="0"{name}>{inner}</{tag}>'

    def advert():
        return off(("div", "div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "promo", "sponsored", "ad-banner"), some(words(3, 14) + ".", f"<p>{words(5, 20)}</p>", f'<a href="/x">{words(2, 8)}</a>'))

    def comments():
        one = "".join(off(("div", "li", "article", "div"), ("comment", "comment-body", "reply"), f"<p>{paragraph()}</p>" + ("" if chance(0.5) else f"<p>{words(3, 9)}</p>")) for _ in range(rng.randint(1, 5)))
        return off(("section", "div", "div"), ("comments", "comment-list", "discussion", "reader-comments", "responses"), f"<h3>{words(1, 3)}</h3>{one}", plain=0)

    def form():
        return off(("form", "form", "div"), ("newsletter", "search-form", "subscribe", "login"), f'<label>{words(1, 4)}</label><input name="q"><p>{words(2, 8)}</p><button>{words(1, 2)}</button>')

    def notice():
        return off(("div", "div", "section", "aside"), ("notice", "cookie-consent", "alert", "gdpr", "disclaimer", "popup"), some(words(6, 25), f"<p>{words(8, 40)}</p><button>{words(1, 2)}</button>"), plain=0)

    def sidebar():
        inner = f"<h3>{words(1, 3)}</h3>{links(rng.randint(3, 8))}" + (f"<p>{words(6, 30)}</p>" if chance(0.5) else "")
        return off(("aside", "aside", "div"), ("sidebar", "related", "widget", "right-rail"), inner, plain=0)

    def body_block(text):
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{text}</p>" if chance(0.8) else f"<p><b>{text}<br>"
        if kind < 0.77:
            return some(f"<div>{text}</div>", f"<div><p>{text}</p></div>", f"<div><span>{text}</span></div>", f"<section><p>{text}</p></section>")
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{words(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        return some(f"<blockquote><p>{text}</p></blockquote>", f"<h2>{words(1, 5)}</h2>", f"<figure><figcaption>{words(3, 9)}</figcaption></figure>", f"<pre>{words(5, 20)}</pre>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<p>{words(1, 3)}.</p>")

    if chance(0.2):
        texts = [f"{words(1, 8)}." for _ in range(rng.randint(1, 3))]
    blocks = [body_block(t) if len(t) > 80 or chance(0.3) else some(f"<p>{t}</p>", f"<p><b>{t}<br>") for t in texts]
    inside = [x for x in (advert() if chance(0.35) else "", notice() if chance(0.15) else "", form() if chance(0.1) else "", sidebar() if chance(0.1) else "", off(("div",), ("share", "social-links"), links(3)) if chance(0.2) else "", off(("footer",), ("post-footer", "tags"), f"<p>{words(1, 6)}</p>") if chance(0.15) else "") if x]
    for x in inside:
        blocks.insert(rng.randint(0, len(blocks)), x)
    if chance(0.35):  # parts of the article in elements of their own
        name = some("", "", "", ' class="body"', ' class="text"', ' class="part"')
        cuts = sorted({0, *(rng.randint(0, len(blocks)) for _ in range(rng.randint(0, 3))), len(blocks)})
        tag = some("div", "section", "div")
        blocks = [f"<{tag}{name}>{f'<h2>{words(1, 4)}</h2>' if chance(0.3) else ''}{''.join(blocks[a:b])}</{tag}>" for a, b in zip(cuts, cuts[1:], strict=False)]
    title = texts[0] if chance(0.2) else words(1, 9)
    heading = some(f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1>{some('', f'<p>{words(1, 4)}</p>')}</header>", f"<h2>{title}</h2>", "")
    tag = some("article", "article", "article", "main", "div", "section", "div")
    name = "" if tag in ("article", "main") and chance(0.6) else f' class="{some("article", "content", "post", "entry-content", "story-body", "main-text", "post-text")}"'
    if tag == "div" and chance(0.3):
        name = ""
    article = f'<{tag} data-main="1"{name}>{heading}{"".join(blocks)}{comments() if chance(0.15) else ""}</{tag}>'
    if chance(0.4):
        around = some("main", "div", "section")
        article = f'<{around}{some("", " id=content", " class=wrapper", " class=container")}>{sidebar() if chance(0.3) else ""}{article}{comments() if chance(0.3) else ""}</{around}>'
    menu = off(("nav", "nav", "div", "ul"), ("menu", "navbar", "nav", "breadcrumbs"), links(rng.randint(3, 9)), plain=0.3)
    top = [menu if chance(0.8) else "", off(("header", "div"), ("header", "masthead", "site-header", "topbar"), f"<p>{words(1, 6)}</p>{menu if chance(0.4) else ''}", plain=0.1) if chance(0.5) else "", notice() if chance(0.3) else "", advert() if chance(0.5) else "", form() if chance(0.2) else ""]
    rng.shuffle(top)
    low = [sidebar() if chance(0.4) else "", comments() if chance(0.4) else "", form() if chance(0.2) else "", advert() if chance(0.2) else ""]
    rng.shuffle(low)
    foot = off(("footer", "footer", "div"), ("footer", "site-footer", "copyright", "bottom"), some("&copy; ", "") + words(3, 20) + (links(4) if chance(0.3) else ""), plain=0.1) if chance(0.9) else ""
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(top)}{article}{''.join(low)}{foot}</body></html>"


def _targets(dom: Dom) -> np.ndarray:
    """1 for elements that hold or are part of the article, 0 for the others; a nearer say counts more."""
    out = np.array(dom.label)
    for i, p in enumerate(dom.parent):
        if out[i] < 0:
            out[i] = out[p] if p >= 0 and out[p] >= 0 else -1
    for i in range(len(out) - 1, -1, -1):  # what holds an article is kept, however it looks
        p = dom.parent[i]
        if p >= 0 and dom.label[p] < 0 and out[i] == 1:
            out[p] = 1
    return np.where(out == 1, 1, 0)


def learn(pages: DataFrame, sample: int = SAMPLE, variants: int = VARIANTS, seed: int = 7) -> Trees:
    """Fit the trees on training pages made of the texts of at most ``sample`` pages (a hash order picks them).

    Their blocks of text are set in many layouts with known articles: menus, adverts, notices, forms,
    sidebars, comments and footers of many tags and names around and inside. Without pages, made-up words stand in.
    """
    rows = first_by_hash(pages.select("page_id", "html").where("html is not null"), ["page_id"], sample).collect()
    rng = random.Random(seed)
    dom = Dom()
    for row in rows or [None]:
        source = Dom()
        source.read(row.html if row else "<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.</p>" * 5)
        blocks = [b for b in (" ".join(p.split()) for _, p in filter(None, source.text)) if len(b) > 30] or ["Lorem ipsum dolor sit amet, consectetur adipiscing."]
        short = " ".join(blocks).split()
        blocks = [entities.escape(b) for b in blocks]
        short = [entities.escape(w) for w in short]
        for _ in range(variants):
            dom.read(training_page(rng, rng.sample(blocks, min(len(blocks), rng.randint(1, 12))), short))
    x, text = dom.features()
    some = text > 0
    return fit(x[some], _targets(dom)[some].astype(float))


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; null and empty pages have an empty one."""
    dom = Dom()
    for s in sources:
        dom.read(s or "")
    if not sources:
        return []
    x, text = dom.features()
    margin = np.zeros(len(x))
    some = text > 0
    margin[some] = trees.margin(x[some])
    return dom.main_text(dom.decode(margin))


def main_texts(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    The whole html is read. Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space in page order. Null html is empty, as is the text of a page
    that has none; ids and urls may be null; repeated rows come back repeated; other columns are ignored.
    """
    source = pages.select("page_id", "url", "html")

    def texts(batches):
        for whole in batches:
            step = 200
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                found = extract(batch.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = source.select("page_id", "url", F.col("html").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    for f in schema:
        f.nullable = True
    return source.mapInArrow(texts, schema)
