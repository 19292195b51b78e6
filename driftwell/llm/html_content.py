"""Main text of web pages by sum-product on the DOM tree (operator 2).

Every element of a page is a binary variable, content or not. Unary potentials are linear in features of the element (tag,
words in its class and id, length and links of its text); pairwise potentials tie each element to its parent. As the
graph is a tree, one pass of messages upward and one downward give exact marginals. Weights are those of a conditional
random field, fitted by gradient ascent on the likelihood of labelled pages (``labelled_pages``: pages of random layouts
whose content is marked); the gradient is features minus their expectations under the same marginals.

A block is the text of a block-level element up to the next block boundary; blocks of elements whose content marginal is
at least one half are kept. Character references are decoded, white space in a block becomes one space, blocks are joined
by two newlines; nothing is dropped or cut otherwise.

Defined cases: null or empty html gives the empty text; unclosed and stray tags follow the usual recovery (a new block
ends an open p, li, td and the like; body, text and any tag that cannot stand in a head
end an open head, and html and body tags may be left out); malformed declarations are comments; pages of any length and
depth are read whole, in time that grows with their length; repeated rows each give their text; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.tokens import unused

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
SILENT = frozenset("script style noscript template head title svg iframe object select option textarea button canvas audio video".split())
#: Tags of formulas: their text belongs to the element around the formula.
MATH = frozenset("annotation annotation-xml maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: Start tags that may stand in a head; any other ends it and starts the body.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div article section main body nav aside header footer form blockquote td th".split())
BAD_WORDS = re.compile(r"nav|menu|header|masthead|footer|sidebar|aside|\bads?\b|advert|banner|sponsor|promo|comment|reply|respon|form|cookie|consent|notice|alert|popup|modal|share|social|related|recommend|subscribe|newsletter|breadcrumb|pagination|pager|toolbar|widget|copyright|login|search|tags?\b|skip", re.I)
GOOD_WORDS = re.compile(r"article|content|main|post\b|post-|entry|story|body|text|page", re.I)
#: What headings and first words of parts that are no content say.
BAD_LEAD = re.compile(
    r"\W*(?:(?:(?:\d+ )?(?:comments?|responses|replies)|related|share|search|menu|tags?|advertisement|sponsored|subscribe|newsletter|log ?in|read (?:more|next)|follow us|about the author)\W*$"
    r"|leave a (?:reply|comment)|join the (?:talk|discussion)|you may also|sign up for|subscribe to|get our (?:letter|newsletter)|tags?:|filed under|posted in|we use cookies|this (?:site|website) uses|skip to)", re.I)  # fmt: skip
TAG_FEATURES = ("article", "main", "section", "div", "p", "h", "li", "ul", "nav", "header", "footer", "aside", "form", "table", "a", "b", "span", "blockquote", "body", "pre", "figure")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section td main article".split())
N_FEATURES = len(TAG_FEATURES) + 24
#: Features that make an element look like no content by itself: tags, class words, first words, the heading above.
OUTSIDE = [*(TAG_FEATURES.index(t) for t in ("nav", "footer", "aside", "form")), len(TAG_FEATURES) + 1, len(TAG_FEATURES) + 12, len(TAG_FEATURES) + 13]


class Tree(HTMLParser):
    """Elements in page order with their parents, and runs of text with the element that holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words, self.marked = [-1], ["#root"], [""], [None]
        self.block = [0]  # of each element, the block-level element that it is or stands in
        self.open = [0]
        self.count: Counter = Counter()  # open elements by tag
        self.texts: list[tuple[int, int, str]] = []  # element, number of the block, text
        self.serial = 0
        self.silent = 0
        self.body = False

    def parse_marked_section(self, i, report=1):
        """<![...]> is a comment up to its >, whatever it holds."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _push(self, tag: str, attrs: dict) -> None:
        k = len(self.tag)
        self.parent.append(self.open[-1])
        self.block.append(k if tag in BLOCK_TAGS else self.block[self.open[-1]])
        self.tag.append(tag)
        self.words.append(" ".join(str(attrs.get(k) or "") for k in ("class", "id", "role")))
        self.marked.append(attrs.get("data-content"))
        self.open.append(k)
        self.count[tag] += 1
        self.silent += tag in SILENT

    def _pop_last(self, tag: str) -> None:
        """Ends the innermost open element of this tag and all inside it; nothing if none is open."""
        while self.count[tag]:
            t = self.tag[self.open.pop()]
            self.count[t] -= 1
            self.silent -= t in SILENT
            self.serial += t in BLOCK_TAGS
            if t == tag:
                return

    def _content(self) -> None:
        """Before what cannot stand in a head: ends an open one, and opens the html and body that the page leaves out."""
        if self.tag[self.open[-1]] == "head":
            self._pop_last("head")
        if not self.body and not self.silent:
            if not self.count["html"]:
                self._push("html", {})
            self._push("body", {})
            self.body = True

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._pop_last("head")
            self.body = True
        elif tag not in IN_HEAD:
            self._content()
        if tag in MATH or (tag in ("html", "body") and self.count[tag]):
            return
        if tag in BLOCK_TAGS:
            self.serial += 1
            if not self.silent:
                self._pop_last("p")
            ends = CLOSES.get(tag, ())
            if any(self.count[t] for t in ends):
                for e in reversed(self.open):
                    t = self.tag[e]
                    if t in ends:
                        self._pop_last(t)
                        break
                    if t in SCOPE:
                        break
        if tag == "br" and not self.silent:
            self.texts.append((self.open[-1], self.serial, " "))
        if tag not in VOID:
            self._push(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._pop_last(tag)

    def handle_data(self, data):
        if data.strip("\ufeff \t\n\r\f"):
            self._content()
        if not self.silent:
            self.texts.append((self.open[-1], self.serial, data))


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


def _static(tag: str, words: str, known: dict) -> tuple:
    """Features of an element that its tag and its class and id decide; ``known`` keeps some thousands of them."""
    key = (tag, words)
    if key in known:
        return known[key]
    if len(known) > 4096:
        known.clear()
    tag = "h" if re.fullmatch(r"h[1-6]", tag) else {"ol": "ul", "em": "b", "strong": "b", "i": "b"}.get(tag, tag)
    known[key] = (*(float(tag == t) for t in TAG_FEATURES), 1.0, float(bool(BAD_WORDS.search(words))), float(bool(GOOD_WORDS.search(words))))
    return known[key]


def features(tree: Tree, known: dict | None = None) -> np.ndarray:
    known = {} if known is None else known
    n, parent = len(tree.tag), tree.parent
    chars, links, stops = [0.0] * n, [0.0] * n, [0.0] * n
    lead = [""] * n  # the first words of an element
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[parent[k]] or tree.tag[k] == "a"
    for e, _, t in tree.texts:
        t = t.strip()
        if t:
            chars[e] += len(t)
            links[e] += len(t) * in_link[e]
            stops[e] += t.count(".") + t.count("!") + t.count("?")
            lead[e] = lead[e] or t[:80]
    prose, titled = [0] * n, [False] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        stops[p] += stops[k]
        titled[p] = titled[p] or titled[k] or tree.tag[k] == "h1"
        prose[p] += prose[k] + (tree.tag[k] == "p")
        lead[p] = lead[k] or lead[p]
    bad = [bool(lead[k]) and bool(BAD_LEAD.match(lead[k])) for k in range(n)]
    section = [False] * n  # of each element, whether the last heading among its children so far opens no content
    under = [False] * n
    for k in range(1, n):
        p = parent[k]
        if tree.tag[k] in HEADINGS:
            section[p] = bad[k]
        under[k] = section[p]
    whole, rows = max(1.0, chars[0]), []
    for k in range(n):
        c, holds = chars[k], tree.tag[k] in CONTAINERS
        rows.append((*_static(tree.tag[k], tree.words[k], known), min(log1p(c) / 6, 1.5), links[k] / max(c, 1.0), c < 25, stops[k] > 0, min(stops[k], 10) / 10, c == 0, c > 200, k > 0 and tree.tag[parent[k]] == "body", c / whole,
                     bad[k], under[k], bad[k] and c > 0.5 * whole, prose[k] > 1, links[k] > 0.6 * c > 0,
                     holds and c > 0.25 * whole, holds and c > 0.5 * whole, holds and c > 0.95 * whole, holds and titled[k], tree.tag[k] in ("html", "#root"),
                     tree.tag[k] == "p" and c > 0.25 * whole, tree.tag[k] in ("article", "main") and titled[k]))
    return np.array(rows, float)


def _lse(a: float, b: float) -> float:
    return max(a, b) + log1p(exp(-abs(a - b)))


def marginals(parent: list[int], unary: list[float], pair: list, joints: bool = False, kind: list[int] | None = None) -> tuple[list, np.ndarray]:
    """Exact marginals by sum-product: P(content) of each element and, if asked for, the (n, 2, 2) of parent and child.

    ``unary`` is the log odds of content and ``pair`` the log potentials by parent's and child's label, one table or, with
    ``kind``, one for each kind of child. Children come after their parents, so one loop upward and one downward pass all
    messages.
    """
    n = len(parent)
    tables, kind = ([pair], [0] * n) if kind is None else (pair, kind)
    up0, up1, sent = [0.0] * n, list(unary), [(0.0, 0.0)] * n
    for k in range(n - 1, 0, -1):
        (p00, p01), (p10, p11) = tables[kind[k]]
        m0, m1 = _lse(p00 + up0[k], p01 + up1[k]), _lse(p10 + up0[k], p11 + up1[k])
        sent[k] = (m0, m1)
        up0[parent[k]] += m0
        up1[parent[k]] += m1
    b0, b1 = up0[:], up1[:]
    both = np.zeros((n, 2, 2)) if joints else np.zeros(0)
    z = _lse(up0[0], up1[0])
    for k in range(1, n):
        p = parent[k]
        (p00, p01), (p10, p11) = tables[kind[k]]
        r0, r1 = b0[p] - sent[k][0], b1[p] - sent[k][1]  # what the parent knows without this child
        b0[k] = up0[k] + _lse(r0 + p00, r1 + p10)
        b1[k] = up1[k] + _lse(r0 + p01, r1 + p11)
        if joints:
            both[k] = ((exp(r0 + p00 + up0[k] - z), exp(r0 + p01 + up1[k] - z)), (exp(r1 + p10 + up0[k] - z), exp(r1 + p11 + up1[k] - z)))
    return [exp(min(0.0, x - z)) for x in b1], both


def kinds(x: np.ndarray) -> np.ndarray:
    """1 for elements that look like no content by themselves (tag, class, first words), else 0: they part from their parent more easily."""
    return (x[:, OUTSIDE].sum(1) > 0).astype(int)


def train(pages: list[str], steps: int = 120, rate: float = 0.3, decay: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """(weights, pairwise log potentials) from pages whose elements carry data-content="1" or "0" for themselves and what is below."""
    data = []
    for p in pages:
        tree = parse(p)
        y = np.zeros(len(tree.tag), int)
        for k in range(1, len(y)):
            y[k] = y[tree.parent[k]] if tree.marked[k] is None else int(tree.marked[k])
        data.append((tree.parent, features(tree), y))
    w, pair, squares = np.zeros(N_FEATURES), np.zeros((2, 2, 2)), np.full(N_FEATURES + 8, 1e-3)
    for _ in range(steps):
        gw, gp = -decay * w * len(data), -decay * pair * len(data)
        for parent, x, y in data:
            kind = kinds(x)
            belief, both = marginals(parent, (x @ w).tolist(), pair.tolist(), True, kind.tolist())
            both[np.arange(1, len(y)), y[np.array(parent[1:])], y[1:]] -= 1
            share = 10 / len(y)  # a page counts alike, however many elements it has
            gw += share * (x.T @ (y - np.array(belief)))
            for c in (0, 1):
                gp[c] -= share * both[1:][kind[1:] == c].sum(0)
        squares += np.concatenate([gw, gp.ravel()]) ** 2
        w += rate * gw / np.sqrt(squares[:N_FEATURES])
        pair += rate * gp / np.sqrt(squares[N_FEATURES:]).reshape(2, 2, 2)
    return w, pair


@lru_cache(1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def extract(html: str | None, model: tuple[np.ndarray, np.ndarray], known: dict | None = None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    tree = parse(html)
    x = features(tree, known)
    belief, _ = marginals(tree.parent, (x @ model[0]).tolist(), model[1].tolist(), kind=kinds(x).tolist())
    blocks: list[list] = []
    last = None
    for e, serial, t in tree.texts:
        if serial != last:
            blocks.append([belief[tree.block[e]] >= 0.5, []])
            last = serial
        blocks[-1][1].append(t)
    texts = (" ".join("".join(parts).split()) for keep, parts in blocks if keep)
    return "\n\n".join(t for t in texts if t)


def _sentences(rng: random.Random, n: int) -> str:
    word = lambda: "".join(rng.choice(("ba", "ke", "lo", "tri", "sun", "ver", "mo", "ti", "and", "el", "o", "ra")) for _ in range(rng.randint(1, 4)))
    return " ".join(" ".join(word() for _ in range(rng.randint(1, 18))).capitalize() + rng.choice("...!?") for _ in range(n))


def _content_parts(rng: random.Random) -> list[str]:
    """What an article holds: paragraphs of all lengths, and now and then lists, quotes, code, figures and tables of data."""
    say = lambda lo, hi: _sentences(rng, rng.randint(lo, hi))
    odd = lambda: rng.choice(("", "", "", ' class="x1"', ' class="lead"', rng.choice(("", "", ' class="comment-free"', ' class="ad-hoc"', ' id="navy"'))))
    parts = [f"<p{odd()}>{rng.choice(('', '', '', '', '', '', '', 'All rights reserved. ', 'Search ', 'Share ', 'Comments on '))}{say(1, 6)}</p>" for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 5, 8, 14)))]
    for k in range(len(parts)):
        form = rng.random()
        if form < 0.12:
            parts[k] = f"<p{odd()}><b>{_sentences(rng, 1)}{rng.choice(('</b></p>', '<br>', '</b>'))}"
        elif form < 0.27:
            parts[k] = f"<p>{_sentences(rng, 1)[: rng.randint(3, 24)]}{rng.choice('. !')}</p>"
        elif form < 0.32:
            parts[k] = f"<p>{(_sentences(rng, 1)[:7] + ' ') * rng.randint(3, 90)}</p>"
    if rng.random() < 0.15:
        parts = [p.removesuffix("</p>") for p in parts]  # paragraphs left open
    for _ in range(rng.choice((0, 0, 1, 2))):
        listed = "".join(f"<li>{say(1, 2)}</li>" for _ in range(rng.randint(2, 5)))
        cells = "".join(f"<tr><td>{_sentences(rng, 1)[:-1]}</td><td>{rng.randint(1, 900)}</td></tr>" for _ in range(rng.randint(2, 5)))
        more = (f"<ul>{listed}</ul>", f"<ol>{listed}</ol>", f"<blockquote><p>{say(1, 3)}</p></blockquote>", f"<pre>{say(1, 2)}</pre>", f"<figure><img><figcaption>{say(1, 1)}</figcaption></figure>",
                f"<table><tr><th>Year</th><th>Amount</th></tr>{cells}</table>", f"<h2>{_sentences(rng, 1)[:-1]}</h2><p>{say(1, 4)}</p>", f"<div><p>{say(1, 3)}</p></div>")
        parts.insert(rng.randint(1, len(parts)), rng.choice(more))
    return parts


def _noise(rng: random.Random, kind: str) -> str:
    """A part that is no content, with or without a telling class."""
    say = lambda lo, hi: _sentences(rng, rng.randint(lo, hi))
    named = lambda names: rng.choice((f' class="{rng.choice(names.split())}"', f' id="{rng.choice(names.split())}"', "", ' class="c7"'))
    links = "<ul>" + "".join(f'<li><a href="/">{_sentences(rng, 1)[:14]}</a></li>' for _ in range(rng.randint(3, 7))) + "</ul>"
    if kind == "nav":
        return rng.choice((f"<nav>{links}</nav>", f"<div{named('menu nav topbar')}>{links}</div>", f"<div{named('breadcrumb')}><a href='/'>Home</a> &gt; <a href='/'>{_sentences(rng, 1)[:9]}</a></div>"))
    if kind == "ad":
        return rng.choice((f'<div class="{rng.choice(("ad", "ads", "banner", "sponsor", "promo"))}">{rng.choice(("", "<p>"))}{say(1, 3)}</div>', f"<div><p>Advertisement</p><p>{say(1, 2)}</p></div>"))
    if kind == "notice":
        return rng.choice((f'<div class="{rng.choice(("cookie-notice", "alert", "consent"))}"><p>{say(1, 2)}</p></div>', f"<div{named('bar')}><p>We use cookies. {say(1, 2)}</p></div>", '<aside class="notice"><p>' + say(1, 2) + "</p></aside>"))
    if kind == "form":
        return rng.choice((f"<form><label>{say(1, 1)}</label><input><p>{say(1, 2)}</p></form>", f"<div{named('box')}><h3>Subscribe</h3><p>{say(1, 2)}</p></div>", f"<div><p>Sign up for our newsletter. {say(1, 2)}</p></div>"))
    if kind == "side":
        return rng.choice((f"<aside><h3>Related</h3>{links}<p>{say(1, 3)}</p></aside>", f"<div{named('sidebar side')}><h3>Read more</h3>{links}</div>", f'<div class="sidebar"><p>{say(1, 4)}</p>{links}</div>'))
    if kind == "share":
        return f"<div{named('share social')}><a href='/'>Share</a> <a href='/'>Follow us</a></div>"
    if kind == "comments":
        one = lambda: rng.choice((f"<div><b>{_sentences(rng, 1)[:8]}</b><p>{say(1, 4)}</p></div>", f"<li><p>{say(1, 3)}</p></li>", f'<div class="comment"><p>{say(1, 3)}</p></div>'))
        head = rng.choice(("Comments", f"{rng.randint(2, 90)} comments", "Leave a reply", "Responses", "Join the discussion"))
        return f"<{(t := rng.choice(('div', 'section')))}{named('comments responses discussion')}><h3>{head}</h3>{''.join(one() for _ in range(rng.randint(1, 5)))}</{t}>"
    if kind == "filed":
        return rng.choice((f"<footer>Filed under {_sentences(rng, 1)}</footer>", f"<p>Tags: <a href='/'>{_sentences(rng, 1)[:8]}</a></p>", f"<footer><p>Posted in <a href='/'>{_sentences(rng, 1)[:8]}</a></p></footer>"))
    if kind == "header":
        return rng.choice((f"<header><h1>{_sentences(rng, 1)[:20]}</h1>{links}</header>", f'<div id="header"><p>{_sentences(rng, 1)[:20]}</p>{links}</div>'))
    return rng.choice((f"<footer>&copy; {say(1, 2)}</footer>", f'<div id="footer"><p>{say(1, 3)}</p></div>', f'<p class="copyright">Copyright {say(1, 1)}</p>', f"<footer><p>{say(1, 3)}</p></footer>"))


def labelled_pages(count: int = 200, seed: int = 41) -> list[str]:
    """Pages of random layouts, the elements of their content marked 1 and what is no content inside it 0."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        parts = _content_parts(rng)
        some = lambda kinds, share: [_noise(rng, k) for k in kinds.split() if rng.random() < share]
        inner = [re.sub(r"^<(\w+)", r'<\1 data-content="0"', x) for x in some("form comments share filed ad", 0.12)]
        title = f"<h1>{_sentences(rng, 1)[:-1]}</h1>"
        head = rng.choice((title, title, title, f"<header>{title}</header>", ""))
        body = head + "".join(parts) + "".join(inner)
        tag = rng.choice(("article", "article", "main", "main", "div", "div", "section"))
        attr = rng.choice(("", ' class="content"', ' class="post"', ' id="story"', ' class="c3"', ""))
        core = f'<{tag}{attr} data-content="1">{body}</{tag}>'
        shape = rng.random()
        if shape < 0.1:
            core = f'<table><tr><td>{_noise(rng, "nav")}</td><td data-content="1">{body}</td></tr></table>'
        elif shape < 0.2:
            core = "".join(re.sub(r"^<(\w+)", r'<\1 data-content="1"', x) for x in [title, *parts])
        elif shape < 0.35:
            core = f"<div{rng.choice(('', ' class=wrap', ' id=page'))}>{core}{''.join(some('side comments ad', 0.3))}</div>"
        share = rng.choice((0.0, 0.2, 0.45, 0.45, 0.6))
        before, after = some("notice header nav ad", share), some("comments side form share footer", share)
        out.append(f"<html><head><title>t</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>")
    return out


def main_text(pages: DataFrame, html_col: str = "html", model: tuple | None = None) -> DataFrame:
    """Adds ``text``, the main text of each page, to the other columns; ``html`` goes."""
    cast = pages.sparkSession.sparkContext.broadcast(model or default_model())
    html = unused(pages, "html_text")
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = [extract(h, cast.value, known) for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return pages.select(*keep, F.col(html_col).cast("string").alias(html)).mapInArrow(run, schema)
