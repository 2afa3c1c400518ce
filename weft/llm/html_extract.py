"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements (inline elements belong to the block they stand in). Each
block has a unary potential from its features — tag, class and id words, length, links — and each
edge a potential over the labels of parent and child. Sum-product messages go up and down the tree
once and give every block's probability of being content. The potentials are trained here, by
gradient ascent on the likelihood of labelled pages (:func:`labelled_pages`).

Text of blocks with a probability of at least one half is returned: character references decoded,
white space inside a block turned into one space, blocks joined by newlines. A line break element is
white space. Scripts, styles, comments, embedded objects and controls of forms are never text.

An article needs no container of its own: labelled pages also have paragraphs, unnamed blocks or bare
text right in the body, and no markup at all.

Defined results: null html is the empty page; a page without content has the empty text; a text
without markup is one block of content; pages may be cut off anywhere; an embedded object that is never
closed hides nothing; repeated rows are extracted one by one.
"""

from __future__ import annotations

import html as entities
import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import whole
from weft.runtime import ship

BLOCKS = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is none of the page's: to their end tag or the end of the page, and, where they
#: can hold their own kind, to the matching end tag if there is one.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NESTED = frozenset("svg math object audio video canvas button select datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCKS - frozenset("html body dd dt li option tbody td tfoot th thead tr summary figcaption".split())
#: A start tag ends an open element of these names, up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Blocks that without class or id say nothing of what they hold.
LAYOUT = frozenset("root html body div center table tbody tr td section".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)


def _past(source: str, at: int, name: str) -> int:
    """Where the element ``name`` that is open at ``at`` ends; ``at`` itself where it never does."""
    depth = 1
    for found in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*?(/?)>", re.I).finditer(source, at):
        depth += -1 if found[1] else 0 if found[2] else 1
        if not depth:
            return found.end()
    return at


class Page:
    """Blocks in page order: ``parent``, ``features``, and the text segments of each."""

    __slots__ = ("parent", "tag", "names", "length", "linked", "segments")

    def __init__(self, source: str):
        self.parent, self.tag, self.names = [-1], ["root"], [()]
        self.length, self.linked = [0], [0]
        self.segments: list[tuple[int, str]] = []
        stack, run, links, at = [0], [], 0, 0

        def flush():
            if run:
                text = " ".join("".join(run).split())
                run.clear()
                if text:
                    self.segments.append((stack[-1], text))

        def say(text: str):
            if "&" in text:
                text = entities.unescape(text)
            run.append(text)
            n = len(text.strip())
            self.length[stack[-1]] += n
            if links:
                self.linked[stack[-1]] += n

        while True:
            found = _TOKEN.search(source, at)
            if found is None:
                if at < len(source):
                    say(source[at:])
                break
            if found.start() > at:
                say(source[at : found.start()])
            at = found.end()
            if name := found[2]:
                name = name.lower()
                if name in RAW and not found[0].endswith("/>"):
                    ends = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = ends.start() if ends else len(source)
                elif name in NESTED:
                    if not found[0].endswith("/>"):
                        at = _past(source, at, name)
                    run.append(" ")
                elif name == "a":
                    links = 1
                elif name in BLOCKS:
                    flush()
                    links = 0
                    tags = self.tag
                    if name in IMPLIED:
                        closes, until = IMPLIED[name]
                        for k in range(len(stack) - 1, 0, -1):
                            if tags[stack[k]] in until:
                                break
                            if tags[stack[k]] in closes:
                                del stack[k:]
                                break
                    elif name in CLOSES_P and tags[stack[-1]] == "p":
                        stack.pop()
                    own = tuple(w for m in _NAMED.finditer(found[3]) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())) if "=" in found[3] else ()
                    if found[3] and _UNSEEN.search(found[3]):
                        own += ("unseen",)
                    self.parent.append(stack[-1])
                    self.tag.append(name)
                    self.names.append(own)
                    self.length.append(0)
                    self.linked.append(0)
                    if name not in VOID:
                        stack.append(len(self.tag) - 1)
                elif name == "br":
                    run.append(" ")
            elif name := found[1]:
                name = name.lower()
                if name == "a":
                    links = 0
                elif name in BLOCKS:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            flush()
                            links = 0
                            del stack[k:]
                            break
        flush()

    def features(self) -> list[list[str]]:
        out = []
        for tag, names, n, linked in zip(self.tag, self.names, self.length, self.linked):
            row = ["bias", "alone" if len(self.tag) == 1 else f"tag={tag}{bool(n):d}", *(f"name={w}" for w in names)]
            if n:
                row.append("long" if n >= 80 else "middle" if n >= 25 else "short")
                share = linked / n
                row.append("links=all" if share > 0.8 else "links=many" if share > 0.3 else "links=few" if share else "links=none")
            out.append(row)
        return out


def _sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(parent: list[int], unary: list[float], edges: list[list[float]]) -> tuple[list[float], list[list[float]], float]:
    """Content probabilities, pair probabilities (per child: 00, 01, 10, 11) and the log partition.

    ``unary`` is the content potential (boilerplate has 0); ``edges`` has for each child the potential
    of the edge to its parent, indexed 2 * parent + child.
    """
    n = len(parent)
    in0, in1 = [0.0] * n, list(unary)  # potential and messages from the children
    up0, up1 = [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):
        a, b, pair = in0[k], in1[k], edges[k]
        up0[k], up1[k] = _sum(pair[0] + a, pair[1] + b), _sum(pair[2] + a, pair[3] + b)
        p = parent[k]
        in0[p] += up0[k]
        in1[p] += up1[k]
    total = _sum(in0[0], in1[0])
    full0, full1 = in0[:], in1[:]  # with the message from the parent
    prob, pairs = [0.0] * n, [[0.0] * 4 for _ in range(n)]
    prob[0] = math.exp(full1[0] - total)
    for k in range(1, n):
        p, pair = parent[k], edges[k]
        out0, out1 = full0[p] - up0[k], full1[p] - up1[k]
        full0[k], full1[k] = in0[k] + _sum(out0 + pair[0], out1 + pair[2]), in1[k] + _sum(out0 + pair[1], out1 + pair[3])
        z = _sum(full0[k], full1[k])
        prob[k] = math.exp(full1[k] - z)
        pairs[k] = [math.exp(x - z) for x in (out0 + pair[0] + in0[k], out0 + pair[1] + in1[k], out1 + pair[2] + in0[k], out1 + pair[3] + in1[k])]
    return prob, pairs, total


def kinds(page: Page) -> list[int]:
    """Of each block's edge: whether its parent says something of what it holds, or is only layout."""
    plain = [tag in LAYOUT and not names for tag, names in zip(page.tag, page.names)]
    return [int(p >= 0 and plain[p]) for p in page.parent]


class Model:
    """Weights of features, and an edge potential for each kind of edge."""

    def __init__(self, weights: dict[str, float], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def unary(self, page: Page) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in page.features()]

    def probabilities(self, page: Page) -> list[float]:
        return marginals(page.parent, self.unary(page), [self.pair[k] for k in kinds(page)])[0]

    def extract(self, source: str) -> str:
        if not source:
            return ""
        page = Page(source)
        prob = self.probabilities(page)
        return "\n".join(text for k, text in page.segments if prob[k] >= 0.5)


def train(pages: list[tuple[Page, list[int]]], rounds: int = 150, rate: float = 0.5, ridge: float = 0.02) -> Model:
    """AdaGrad ascent on the likelihood; labels are 1 for content blocks."""
    names = sorted({f for page, _ in pages for row in page.features() for f in row})
    weights, pair = dict.fromkeys(names, 0.0), [[0.0] * 4 for _ in range(2)]
    seen, seen_pair = dict.fromkeys(names, 1e-6), [[1e-6] * 4 for _ in range(2)]
    rows = [(page.parent, kinds(page), page.features(), labels) for page, labels in pages]
    for _ in range(rounds):
        slope, slope_pair = {f: -ridge * w for f, w in weights.items()}, [[-ridge * w for w in own] for own in pair]
        for parent, kind, features, labels in rows:
            prob, pairs, _total = marginals(parent, [sum(weights[f] for f in row) for row in features], [pair[k] for k in kind])
            for k, row in enumerate(features):
                off = labels[k] - prob[k]
                for f in row:
                    slope[f] += off
                if k:
                    for c in range(4):
                        slope_pair[kind[k]][c] += (c == 2 * labels[parent[k]] + labels[k]) - pairs[k][c]
        for f, g in slope.items():
            seen[f] += g * g
            weights[f] += rate * g / math.sqrt(seen[f])
        for own, slopes, total in zip(pair, slope_pair, seen_pair):
            for c, g in enumerate(slopes):
                total[c] += g * g
                own[c] += rate * g / math.sqrt(total[c])
    return Model(weights, pair)


#: Boilerplate elements of the labelled pages: what they are and how sites mark them.
BOILERPLATE = (
    '<nav><ul><li><a href="/">{w}</a></li><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li></ul></nav>',
    '<div class="menu"><a href="/">{w}</a> <a href="/b">{w}</a></div>',
    '<div id="navigation" class="navbar"><ul><li><a href="/x">{w}</a></li><li><a href="/y">{w}</a></li></ul></div>',
    '<header><a href="/">{w}</a><p>{s}</p></header>',
    '<div class="header site-header"><h1>{w}</h1><p>{s}</p></div>',
    '<footer>&copy; {w} {s} &middot; <a href="/t">{w}</a></footer>',
    '<footer><p>{s}</p><ul><li><a href="/p">{w}</a></li></ul></footer>',
    '<div class="footer" id="footer"><p>{s}</p></div>',
    "<aside><h2>{w}</h2><p>{s}</p><p>{l}</p></aside>",
    '<div class="sidebar"><h3>{w}</h3><p>{l}</p><ul><li><a href="/r">{w}</a></li></ul></div>',
    '<div class="ad">{s}</div>',
    '<div class="ad">{l}</div>',
    '<div class="advert ads advertisement sponsored"><p>{s}</p></div>',
    '<div id="banner" class="banner promo"><p>{s}</p></div>',
    '<div class="cookie consent notice"><p>{l}</p><p>{s}</p></div>',
    '<div class="cookie-notice" role="alert">{s}</div>',
    '<div class="newsletter subscribe"><p>{s}</p><form><p>{w}</p></form></div>',
    "<form><p>{s}</p><select><option>{w}<option>{w}</select></form>",
    '<form class="search login"><div>{w}</div></form>',
    '<div class="related"><h3>{w}</h3><ul><li><a href="/q">{s}</a></li></ul></div>',
    '<div class="social share"><a href="/f">{w}</a> <a href="/g">{w}</a></div>',
    '<div class="breadcrumb breadcrumbs"><a href="/">{w}</a> <a href="/c">{w}</a></div>',
    '<section class="comments" id="comments"><h2>{w}</h2><div class="comment"><p>{l}</p></div><div class="comment"><p>{s}</p></div></section>',
    '<div id="comments"><ol class="commentlist"><li class="comment"><p>{l}</p></li><li class="comment"><p>{s}</p></li></ol></div>',
    '<div class="disclaimer popup modal"><p>{s}</p></div>',
    "<div hidden><p>{s}</p></div>",
    '<div style="display:none"><p>{l}</p></div>',
    '<p aria-hidden="true">{s}</p>',
    '<div class="widget author meta tags"><p>{s}</p></div>',
    '<div class="comments"><p>{l}</p><p>{s}</p></div>',
    '<section class="reactions discussion replies responses"><p>{l}</p><p>{l}</p></section>',
    '<div class="footer bottom copyright legal">{s}</div>',
    '<section id="respond" class="comment replies"><h3>{w}</h3><form><p>{s}</p></form></section>',
    '<div class="alert warning message"><p>{s}</p></div>',
)
CONTAINERS = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content article" id="content">', "</div>"), ('<div class="post entry story">', "</div>"), ('<section class="text body">', "</section>"), ("<main><article>", "</article></main>"), ('<div role="main" id="main">', "</div>"))
#: Names that mark any element as boilerplate, and elements that take one of them.
NAMES = "nav navigation navbar menu header masthead footer sidebar ad ads advert banner promo sponsored cookie consent notice newsletter subscribe search login related social share breadcrumbs comments comment replies respond disclaimer popup modal widget copyright".split()
MARKED = ('<div class="%s">{s}</div>', '<div id="%s">{w}</div>', '<div id="%s"><p>{l}</p></div>', '<section class="%s"><p>{s}</p><p>{l}</p></section>', '<ul class="%s"><li>{w}<li>{s}</ul>')
#: What holds an article that no tag or name marks.
UNNAMED = (("", ""), ("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<center>", "</center>"), ("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>"), ('<div id="q" class="x">', "</div>"))
#: Content that is text right in its container.
BARE = ("{l}", "{l}<br>{l}", "{s} <b>{l}</b> {l}", "{l}<p>{l}</p>")
CONTENT = ("<h1>{s}</h1>", "<h2>{s}</h2>", "<p>{l}</p>", "<p>{l}</p>", "<p>{s}</p>", "<p>{w}</p>", "<p><b>{s}<br><p>{l}", "<p>{l} <a href='/z'>{w}</a> {s}</p>", "<ul><li>{s}</li><li>{l}</li></ul>", "<blockquote><p>{l}</p></blockquote>", "<pre>{l}</pre>", "<table><tr><td>{s}</td><td>{w}</td></tr></table>", "<div>{l}</div>", "<section><h3>{s}</h3><p>{l}</p></section>", "<figure><figcaption>{s}</figcaption></figure>", "<h3>{w}</h3>")
MARK = "\x02"


def labelled_pages(n: int = 320, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Pages composed of the elements above. Content words carry a mark that only labelling sees."""
    import random

    draw = random.Random(seed)

    def fill(part: str, mark: str) -> str:
        words = lambda k: " ".join(mark + "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(k))
        return re.sub(r"\{([wsl])\}", lambda m: words({"w": draw.randint(1, 2), "s": draw.randint(3, 9), "l": draw.randint(15, 40)}[m[1]]) + "." * (m[1] != "w"), part)

    def boilerplate(k: int) -> list[str]:
        return [draw.choice(MARKED) % draw.choice(NAMES) if draw.random() < 0.4 else thin(draw.choice(BOILERPLATE)) for _ in range(k)]

    def thin(part: str) -> str:
        """Some of each element's names, one at least, so that every name learns to stand alone."""
        return re.sub(r'class="([^"]+)"', lambda m: 'class="' + " ".join(draw.sample(m[1].split(), draw.randint(1, len(m[1].split())))) + '"', part)

    out = []
    for _ in range(n):
        around = lambda k: [fill(part.replace("<li>", "<li>{w}</li><li>" * draw.choice((0, 0, 9)) + "<li>"), "") for part in boilerplate(draw.randint(0, k))]  # noqa: E731, B023
        named = draw.random() < 0.6
        opens, ends = draw.choice(CONTAINERS if named else UNNAMED)
        inner = [fill(draw.choice(CONTENT), MARK) for _ in range(draw.randint(0 if named else 3, 7))]
        if draw.random() < 0.35:  # many short paragraphs make an article too
            inner += [fill(draw.choice(("<p>{w}</p>", "<p>{s}</p>", "<li>{w}")), MARK) for _ in range(draw.randint(15, 60))]
        if not named and draw.random() < 0.4:
            inner = [fill(draw.choice(BARE), MARK)]
        if draw.random() < 0.4:
            inner.insert(draw.randint(0, len(inner)), fill(boilerplate(1)[0], ""))
        source = "<html><body>" + "".join([*around(3), opens, fill("<h1>{s}</h1>", MARK) if named or draw.random() < 0.4 else "", *inner, ends, *around(3)]) + "</body></html>"
        if draw.random() < 0.3:
            source = source.replace("<body>", '<body><div class="page wrapper">').replace("</body>", "</div></body>")
        elif draw.random() < 0.15:
            source = source.replace("<html><body>", "").replace("</body></html>", "")
        elif draw.random() < 0.12:
            source = "".join(fill(draw.choice(("<p>{l}</p>", "<p>{s}</p>", "<p>{w}</p>")), MARK) for _ in range(draw.randint(1, 4)))
        elif draw.random() < 0.1:
            source = fill("\n\n".join(draw.choices(("{l}", "{s}"), k=draw.randint(1, 4))), MARK)
        page = Page(source)
        label, plain = [0] * len(page.tag), [0] * len(page.tag)
        for k, text in page.segments:
            if MARK in text:
                label[k] = 1
            else:
                plain[k] = 1
        for k in range(len(label) - 1, 0, -1):  # a container is content where all or most below it is
            if not label[k] and not plain[k]:
                below = [c for c in range(k + 1, len(label)) if page.parent[c] == k]
                label[k] = int(bool(below) and 2 * sum(label[c] for c in below) > len(below))
        page.length = [sum(len(t.replace(MARK, "")) for k, t in page.segments if k == j) for j in range(len(label))]
        out.append((page, label))
    return out


@cache
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (), model: Model | None = None) -> DataFrame:
    """``id`` (and the columns ``keep``), ``text, n_chars`` for every row."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), *keep, whole(html_col).alias("html"))
    fields = [rows.schema[c] for c in ("id", *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long"
    model = model or default_model()
    weights, pair = model.weights, model.pair

    def run(batches):
        own = Model(weights, pair)
        for batch in batches:
            texts = [own.extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in fields), "text", "n_chars"])

    return rows.mapInArrow(run, schema)
