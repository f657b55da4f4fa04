"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: text between block-level tags, with the tags, classes, ids and roles of its ancestors. Text
outside rendering (head, scripts, styles, templates, comments of the markup) makes no block. Each block has features of its
ancestors and of its text; the chain over the blocks in page order is trained on labelled pages, by the gradient of the
conditional likelihood, and decoded by Viterbi into main text and the rest. Labelled pages come from a generator that lays
out menus, headers, notices, adverts, articles, sidebars, forms, comments and footers in many ways; it takes seconds, once a process.

In a block, character references are decoded in each text node, white space becomes one space and is trimmed; a <br> is
white space. Main blocks are joined by a line break; nothing else is dropped or cut.

Defined results: null, empty or text-free html gives "". Unclosed tags, scripts and comments run to where HTML ends
them, if need be the end of the page. Each row has its own result, so repeated rows have equal ones.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm.common import chunks

TAG = re.compile(r"<(?:!--|!|\?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>)")
ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME = re.compile(r"[a-z]+")

#: Classes of tags in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "annotation", "annotation-xml", "select", "xmp", "noembed", "noframes"}
#: Of these, those whose text is raw also without an end tag, and foreign content, where a tag ending in "/" is empty.
TO_END = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
FOREIGN = {"svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of these names, up to a container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "form"}


class Block:
    __slots__ = ("context", "linked", "tag", "text")

    def __init__(self, text, tag, context, linked):
        self.text, self.tag, self.context, self.linked = text, tag, context, linked


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; context: features of the ancestors, one string each."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # name, features with all ancestors' ones, in a link
    parts: list[str] = []
    linked = at = 0
    hidden = None  # the head's depth, while in it
    unclosed: set[str] = set()  # names without an end tag further on

    def add(raw: str) -> None:
        nonlocal linked
        if hidden is None and raw:
            s = htmllib.unescape(raw) if "&" in raw else raw
            parts.append(s)
            if stack and stack[-1][2]:
                linked += len(s)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag = next((n for n, *_ in reversed(stack) if n in BLOCK), "body")
                out.append(Block(text, tag, stack[-1][1] if stack else (), linked / max(len(text), 1)))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal hidden
        if any(n in BLOCK for n, *_ in stack[k:]):
            flush()
        del stack[k:]
        if hidden is not None and len(stack) <= hidden:
            hidden = None

    pos = 0
    while True:
        m = TAG.search(page, pos)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m[2] is None:
            end = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
            at = pos = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        name, at = m[2].lower(), m.end()
        pos = at
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                close(k)
            continue
        if name in unclosed or name in FOREIGN and m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, pos)
            if end is None and name not in TO_END:  # never closed: its text is text
                unclosed.add(name)
                continue
            if name == "xmp" and hidden is None:  # its text is shown as it stands
                flush()
                parts.append(page[pos : len(page) if end is None else end.start()])
                flush()
            stop = len(page) if end is None else page.find(">", end.end())
            at = pos = len(page) if stop < 0 or end is None else stop + 1
            continue
        if name == "br":
            if hidden is None:
                parts.append(" ")
            continue
        if name == "head" and hidden is None:
            hidden = len(stack)
        elif hidden is not None and (name == "body" or name in BLOCK):  # both tags around can be left out
            close(hidden)
        if name in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
            if name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS[name]:
                        close(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        above, link = (stack[-1][1], stack[-1][2]) if stack else ((), False)
        new = [f"in:{name}"] if name in BLOCK else []
        if m[3] and ("=" in m[3]):
            for a in ATTRIBUTE.findall(m[3]):
                new += [f"is:{t}" for t in NAME.findall("".join(a).lower())]
        stack.append((name, above + tuple(x for x in new if x not in above), link or name == "a"))
    flush()
    return out


def features(b: Block, k: int, n: int) -> list[str]:
    words = b.text.count(" ") + 1
    last = b.text[-1]
    return [
        "bias",
        f"tag:{b.tag}",
        *b.context,
        "links:" + ("none" if b.linked == 0 else "some" if b.linked < 0.5 else "most"),
        "words:" + ("1" if words == 1 else "2-4" if words < 5 else "5-14" if words < 15 else "15-39" if words < 40 else "40+"),
        "ends:" + ("stop" if last in ".!?…\"”»" else "letter" if last.isalpha() else "other"),
        *(["sign"] if "©" in b.text or "®" in b.text else []),
        *(["bar"] if " | " in b.text or " · " in b.text else []),
        *(["first"] if k == 0 else []),
        *(["last"] if k == n - 1 else []),
    ]


class Chain:
    """Weights of features for the two labels (0 rest, 1 main) and of the transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps
        self.of = {f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in index.items()}

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        of, ((s00, s01), (s10, s11)), n = self.of, self.steps.tolist(), len(blocks)
        none, back, a, b = (0.0, 0.0), [], 0.0, 0.0
        for k, block in enumerate(blocks):
            e = [of.get(f, none) for f in features(block, k, n)]
            e0, e1 = sum(x[0] for x in e), sum(x[1] for x in e)
            if k:
                f0, f1 = b + s10 > a + s00, b + s11 > a + s01
                back.append((f0, f1))
                a, b = e0 + (b + s10 if f0 else a + s00), e1 + (b + s11 if f1 else a + s01)
            else:
                a, b = e0, e1
        if not blocks:
            return []
        out = [int(b > a)]
        for f in reversed(back):
            out.append(int(f[out[-1]]))
        return out[::-1]


def train_chain(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """By Adam on the conditional log likelihood of all pages at once."""
    rows = [[features(b, k, len(bs)) for k, b in enumerate(bs)] for bs, _ in pages]
    seen: dict[str, int] = {}
    for page in rows:
        for f in {x for r in page for x in r}:
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 2))}
    longest = max(len(p) for p in rows)
    x = np.zeros((len(rows), longest, len(index)), np.float32)
    y, live = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
    for i, (page, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        for t, r in enumerate(page):
            x[i, t, [index[f] for f in r if f in index]] = 1
            y[i, t], live[i, t] = labels[t], True
    w, s = np.zeros((len(index), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    both = live[:, 1:] & live[:, :-1]
    gold_steps = np.zeros((2, 2))
    np.add.at(gold_steps, (y[:, :-1][both], y[:, 1:][both]), 1)
    gold = np.eye(2)[y] * live[:, :, None]
    for step in range(1, rounds + 1):
        e = (x @ w) * live[:, :, None]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + s, axis=1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        logz = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(s + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], new, beta[:, t + 1])
        p = np.exp(alpha + beta - logz[:, None, None]) * live[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + s + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None])
        gw = np.tensordot(x, gold - p, ([0, 1], [0, 1])) / len(rows) - ridge * w
        gs = (gold_steps - pair[both].sum(0)) / len(rows) - ridge * s
        for k, (param, grad) in enumerate(((w, gw), (s, gs))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(index, w, s)


def labelled_page(r: np.random.Generator) -> tuple[str, list[int]]:
    """An invented page and the labels of its blocks."""
    out: list[str] = []
    labels: list[int] = []
    pick = lambda *x: x[r.integers(len(x))]
    word = lambda: "".join("etaoinshrdlucmfwyp"[k] for k in r.integers(0, 18, r.integers(1, 10)))
    text = lambda lo, hi: " ".join(word() for _ in range(r.integers(lo, hi))).capitalize() + pick(".", ".", ".", "", "!")
    maybe = lambda p: r.random() < p

    def put(markup: str, *main: int) -> None:
        out.append(markup)
        labels.extend(main)

    def links(n, sep="li"):
        for _ in range(n):
            put(f'<{sep}><a href="/{word()}">{text(1, 4).strip(".!")}</a></{sep}>', 0)

    def paragraphs(n, main):
        for _ in range(n):
            body = pick(text(1, 4), text(5, 25), text(20, 120), text(20, 120))
            if maybe(0.15):
                body += f' <a href="/x">{word()}</a> {word()}.'
            put(pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f'<p class="{pick("lead", "text", "body")}">{body}</p>'), main)

    def menu():
        open_, shut = pick(("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="navigation">', "</div>"), ('<nav class="navbar">', "</nav>"), ('<div role="navigation">', "</div>"))
        put(open_ + "<ul>")
        links(int(r.integers(2, 9)))
        put("</ul>" + shut)

    def advert():
        kind = pick("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement")
        tag = pick("div", "div", "aside", "section")
        put(f'<{tag} class="{kind}">{text(3, 14)}</{tag}>', 0)

    def notice():
        kind = pick("cookie-notice", "consent", "notice", "cookie banner", "alert", "gdpr notice")
        put(f'<div {pick("class", "id")}="{kind}"><p>{text(5, 30)}</p>', 0)
        put(f"<button>{word()}</button></div>", 0)

    def form():
        put(f'<form class="{pick("search", "newsletter", "login", "subscribe", "")}"><label>{text(1, 5)}</label><input name="q">', 0)
        put(f"<button>{word()}</button>", 0)
        if maybe(0.5):
            put(f"<p>{text(4, 20)}</p>", 0)
        put("</form>")

    def comments():
        kind = pick("comments", "comment-list", "responses", "disqus comments", "discussion comments")
        tag = pick("section", "div", "div")
        put(f'<{tag} {pick("class", "id")}="{kind}"><h{pick(2, 3)}>{text(1, 4)}</h3>', 0)
        for _ in range(r.integers(1, 6)):
            put(f'<div class="{pick("comment", "comment-body", "reply comment")}"><p>{text(2, 50)}</p></div>', 0)
        put(f"</{tag}>")

    def related():
        put(f'<{pick("aside", "div", "section")} class="{pick("related", "share social", "sidebar", "widget", "related-posts")}"><h3>{text(1, 4)}</h3><ul>', 0)
        links(int(r.integers(1, 5)))
        put("</ul></aside></div></section>")

    def article():
        n = int(r.integers(1, 12))
        open_, shut = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f'<div class="{pick("content", "post", "entry-content", "article-body", "story", "post-content", "main-content")}">', "</div>"), (f'<div id="{pick("content", "main", "article", "story")}">', "</div>"), (f'<section class="{pick("content", "article", "post")}">', "</section>"))
        put(open_)
        if maybe(0.8):
            put(f"<h1>{text(2, 12)}</h1>", 1)
        for _ in range(n):
            what = r.random()
            if what < 0.72:
                paragraphs(int(r.integers(1, 4)), 1)
            elif what < 0.8:
                put(f"<h2>{text(1, 6)}</h2>", 1)
            elif what < 0.86:
                put("<ul>")
                for _ in range(r.integers(1, 5)):
                    put(f"<li>{text(1, 20)}</li>", 1)
                put("</ul>")
            elif what < 0.9:
                put(f"<blockquote>{text(5, 40)}</blockquote>", 1)
            elif what < 0.93:
                put(f"<pre>{text(3, 20)}</pre>", 1)
            elif what < 0.96:
                advert()
            else:
                put(f"<table><tr><td>{text(1, 6)}</td>", 1)
                put(f"<td>{text(1, 6)}</td></tr></table>", 1)
        if maybe(0.1):
            comments()
        put(shut)

    put(f"<!DOCTYPE html><html><head><title>{text(2, 8)}</title><script>var a='<p>';</script></head><body>")
    if maybe(0.4):
        put(pick("<header>", '<div class="header">', '<div id="masthead">') + f"<{pick('h1', 'h2', 'div', 'p')}>{text(1, 5)}</p></h1></h2></div>", 0)
        if maybe(0.5):
            put(f"<p>{text(3, 9)}</p>", 0)
        put("</header></div>")
    for part in ((menu, 0.85), (notice, 0.3), (advert, 0.5), (form, 0.2), (related, 0.15)):
        if maybe(part[1]):
            part[0]()
    article()
    for part in ((advert, 0.2), (related, 0.35), (comments, 0.35), (form, 0.2), (notice, 0.1), (menu, 0.1)):
        if maybe(part[1]):
            part[0]()
    if maybe(0.9):
        put(pick("<footer>", "<footer>", '<div class="footer">', '<div id="footer">') + pick(f"&copy; {word()}.example.com &middot; {text(2, 12)}", f"<p>&copy; 2020 {word()}</p>", text(2, 10), f"{word()} | {word()} | {word()}") + "</footer></div>", 0)
    return "".join(out), labels


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 5) -> Chain:
    r = np.random.default_rng(seed)
    made = []
    while len(made) < pages:
        page, labels = labelled_page(r)
        blocks = blocks_of(page)
        if len(blocks) == len(labels) and blocks:
            made.append((blocks, labels))
    return train_chain(made)


def main_text(page: str, chain: Chain) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, chain.decode(blocks), strict=True) if y)


def extract_main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """df without its html, with the main text (which replaces a column of that name)."""
    chain = trained()
    model = df.sparkSession.sparkContext.broadcast((chain.index, chain.weights, chain.steps))
    inner = df.select(*[df[c] for c in df.columns if c not in (html, text)], F.coalesce(df[html], F.lit("")).alias("__html"))
    keep = inner.columns[:-1]
    schema = T.StructType([f for f in inner.schema.fields if f.name != "__html"] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*model.value)
        for batch in batches:
            for part in chunks(batch, "__html", 4 << 20):
                texts = [main_text(p, own) for p in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text])

    return inner.mapInArrow(run, schema)
