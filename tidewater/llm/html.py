"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks in order: text between block-level tags, with the open elements' tags, classes,
ids and roles as its path. A block becomes a vector of its hashed path, its hashed words and a few measures. A
bidirectional LSTM (numpy) reads the page's whole sequence and labels every block as main text or not. It is trained on pages
made by rule (`made_page`), whose blocks carry their labels: articles in many wrappers, among menus, headers,
footers, sidebars, notices, adverts, forms and reader comments.

What browsers don't show (scripts, styles, markup comments, the head, which may lack its end tag) and what forms are
filled in with never become blocks; formulas, drawings' labels and buttons are inline text. Character references are
decoded, white space inside a block is one space, blocks are joined by a newline. Reading is linear in a page's length
and depth.

Defined cases: null or blank html has the empty text; unclosed and misnested tags close at their parent's end, a new
paragraph ends an open one; pages and blocks of any length are read whole; repeated rows each get a row; null ids and
urls pass through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+)|<", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[A-Za-z0-9]+")
#: Elements of the HTML standard, by how they are read.
HIDDEN = frozenset("script style noscript template head title desc annotation annotation-xml iframe select textarea option datalist".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img button svg g text tspan textpath object canvas audio video picture map ruby rb rt rp rtc output meter progress "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics annotation annotation-xml".split())
#: Elements that an open one's end tag may be left out before.
SIBLINGS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: What may stand in a head; any other tag, or text, ends a head whose end tag is left out.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())

PATH, BAG, EXTRA, HIDDEN_UNITS = 96, 48, 6, 16
WIDTH = PATH + BAG + EXTRA
PAGES, EPOCHS, BATCH, RATE, SEED = 450, 4, 32, 0.01, 11


class Block:
    __slots__ = ("path", "text", "linked", "main")

    def __init__(self, path: bytes, text: str, linked: int, main: bool = False):
        self.path, self.text, self.linked, self.main = path, text, linked, main


@lru_cache(maxsize=4096)
def marks(tag: str, attrs: str) -> tuple[int, ...]:
    """Places in the path vector of an element's tag and the words of its class, id and role."""
    out = [tag]
    if "=" in attrs:
        for m in ATTR.finditer(attrs):
            for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower()):
                out += ["." + w, f"{tag}.{w}"]
    return tuple(zlib.crc32(m.encode()) % PATH for m in out)


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order; a block's path is how often each place occurs in the open elements, 2 at most."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    opened: dict[str, int] = {}
    held, path = [0] * PATH, None
    parts: list[str] = []
    linked = links = hidden = 0
    pos = 0

    def flush() -> None:
        nonlocal linked, path
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = _html.unescape(text)
            text = " ".join(text.split())
            if text:
                if path is None:
                    path = bytes([min(2, n) for n in held])
                out.append(Block(path, text, linked))
            parts.clear()
        linked = 0

    def step(tag: str, places: tuple[int, ...], by: int) -> None:
        nonlocal hidden, links, path
        opened[tag] = opened.get(tag, 0) + by
        hidden += by * (tag in HIDDEN)
        links += by * (tag == "a")
        if tag not in INLINE:
            path = None
            for k in places:
                held[k] += by

    def close(at: int) -> None:
        for t, places in stack[at:]:
            step(t, places, -1)
        del stack[at:]

    def last(tag: str) -> int:
        return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1) if opened.get(tag) else -1

    while m := TOKEN.match(page, pos):
        pos = m.end()
        tag = m[2]
        if tag is None:
            text = m[4] or ("<" if m[0] == "<" else None)
            if text and stack and stack[-1][0] == "head" and text.strip():
                close(len(stack) - 1)
            if text and not hidden:
                parts.append(text)
                linked += len(text) * (links > 0)
            continue
        tag = tag.lower()
        if hidden and not m[1] and tag not in IN_HEAD and (at := last("head")) >= 0:
            close(at)
        if tag == "br":
            parts.append(" ")
        elif m[1]:
            at = last(tag)
            if at >= 0:
                if tag not in INLINE:
                    flush()
                elif any(t not in INLINE for t, _ in stack[at + 1 :]):
                    continue  # a stray inline end doesn't close blocks
                close(at)
            elif tag not in INLINE:
                flush()
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if tag not in INLINE:
                flush()
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), -1)
                if at >= 0 and (stack[at][0] == "p" or (stack[at][0] in SIBLINGS.get(tag, ()))):
                    close(at)
                k = len(stack)  # unclosed inline elements end with their block
                while k and stack[k - 1][0] in INLINE and stack[k - 1][0] != "a":
                    k -= 1
                close(k)
            if m[3].endswith("/") and tag not in RAW:
                continue
            stack.append((tag, places := marks(tag, m[3] if len(m[3]) < 2000 else m[3][:2000])))
            step(tag, places, 1)
            if tag in RAW:  # its content isn't markup
                end = re.compile(rf"</{tag}\b", re.I).search(page, pos)
                pos = end.start() if end else len(page)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), WIDTH), np.float32)
    x[:, :PATH] = np.frombuffer(b"".join([b.path for b in found]), np.uint8).reshape(-1, PATH)
    for i, b in enumerate(found):
        words = b.text.lower().encode("utf-8", "replace").split()
        bag = np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BAG, minlength=BAG)
        x[i, PATH : PATH + BAG] = bag / (bag.sum() ** 0.5)
        n = len(b.text)
        x[i, -EXTRA:] = (np.log1p(n) / 6, min(1.0, b.linked / n), sum(map(b.text.count, ".,;")) / len(words), i / len(found), len(words) < 5, 1.0)
    return x


class Labeller:
    """Bidirectional LSTM over block vectors; one logistic unit on both states."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN_UNITS
        self.p = {}
        for way in "fb":
            self.p["w" + way] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * h)).astype(np.float32)
            self.p["u" + way] = rng.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
            self.p["c" + way] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.2, (2 * h, 1)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States of one direction, n x t x h, and, to `keep`, what training needs; padding leaves the state as it was."""
        n, t, _ = x.shape
        h_n = HIDDEN_UNITS
        pre = (x.reshape(n * t, -1) @ self.p["w" + way]).reshape(n, t, 4 * h_n) + self.p["c" + way]
        h, c = np.zeros((n, h_n), np.float32), np.zeros((n, h_n), np.float32)
        out, saved = np.zeros((n, t, h_n), np.float32), [None] * t
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            g = pre[:, k] + h @ self.p["u" + way]
            i, f, o, a = self._sig(g[:, :h_n]), self._sig(g[:, h_n : 2 * h_n]), self._sig(g[:, 2 * h_n : 3 * h_n]), np.tanh(g[:, 3 * h_n :])
            c_new = f * c + i * a
            tc = np.tanh(c_new)
            m = mask[:, k, None]
            if keep:
                saved[k] = (h, c, i, f, o, a, tc)
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[:, k] = h
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf = self._run(x, mask, "f", keep)
        b, sb = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], 2)
        return both, (both @ self.p["out"])[:, :, 0] + self.p["bias"][0], (sf, sb)

    def grads(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, t, _ = x.shape
        h_n = HIDDEN_UNITS
        both, z, saved = self.logits(x, mask, True)
        dz = (self._sig(z) - y) * mask / mask.sum()
        out = {"out": both.reshape(n * t, -1).T @ dz.reshape(-1, 1), "bias": np.array([dz.sum()], np.float32)}
        d_both = dz[:, :, None] * self.p["out"][:, 0]
        for way, s, d_h in (("f", saved[0], d_both[:, :, :h_n]), ("b", saved[1], d_both[:, :, h_n:])):
            dg_all, du = np.zeros((n, t, 4 * h_n), np.float32), np.zeros_like(self.p["u" + way])
            dh, dc = np.zeros((n, h_n), np.float32), np.zeros((n, h_n), np.float32)
            for k in range(t - 1, -1, -1) if way == "f" else range(t):
                h, c, i, f, o, a, tc = s[k]
                m = mask[:, k, None]
                dh = dh + d_h[:, k]
                live, d_tc = np.where(m, dh, 0), 0
                d_tc = live * o * (1 - tc * tc) + np.where(m, dc, 0)
                dg = np.concatenate([d_tc * a * i * (1 - i), d_tc * c * f * (1 - f), live * tc * o * (1 - o), d_tc * i * (1 - a * a)], 1)
                dg_all[:, k] = dg
                du += h.T @ dg
                dh = np.where(m, dg @ self.p["u" + way].T, dh)
                dc = np.where(m, d_tc * f, dc)
            flat = dg_all.reshape(n * t, -1)
            out |= {"w" + way: x.reshape(n * t, -1).T @ flat, "u" + way: du, "c" + way: flat.sum(0)}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        u = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for i in range(0, len(pages), BATCH):
                x, mask, y = padded([pages[k] for k in order[i : i + BATCH]])
                t += 1
                for k, g in self.grads(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    u[k] = 0.98 * u[k] + 0.02 * g * g
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(u[k] / (1 - 0.98**t)) + 1e-7)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text. Pages of like length are padded together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 128 and len(pages[order[end]]) * (end + 1 - at) <= 40_000:
                end += 1
            some = order[at:end]
            x, mask, _ = padded([(pages[i], None) for i in some])
            z = self.logits(x, mask)[1]
            for row, i in enumerate(some):
                out[i] = z[row, : len(pages[i])] > 0
            at = end
        return out


def padded(pages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((len(pages), t, WIDTH), np.float32), np.zeros((len(pages), t), bool), np.zeros((len(pages), t), np.float32)
    for i, (f, label) in enumerate(pages):
        x[i, : len(f)], mask[i, : len(f)] = f, True
        if label is not None:
            y[i, : len(f)] = label
    return x, mask, y


MAIN = "\x01"  # marks labelled text in made pages


def made_page(r: random.Random) -> str:
    """A page by rule; MAIN stands before each text that belongs to the article."""
    word = lambda: "".join(r.choice(("an", "ter", "lo", "mi", "sch", "que", "ing", "the", "ra", "on", "é", "du")) for _ in range(r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() + r.choice(("", "", "", ",", ".")) for _ in range(r.randint(a, b)))

    def wrap(tags: tuple[str, ...], body: str) -> str:
        t = r.choice(tags)
        name = t.split()[0]
        return f"<{t}>{body}</{name}>"

    links = lambda k: "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(k))
    paras = lambda k, a=3, b=60: "".join(wrap(("p", "p", "p", "div"), words(a, b)) for _ in range(k))
    aside = [
        lambda: wrap(("nav", 'nav class="menu"', 'div class="nav"', 'div id="menu"', 'ul class="navbar"', 'div role="navigation"'), f"<ul>{links(r.randint(2, 9))}</ul>"),
        lambda: wrap(("header", 'div class="header"', 'div id="masthead"'), wrap(("h1", "div", "p", "span"), words(1, 4)) + r.choice(("", f"<ul>{links(3)}</ul>", paras(1, 2, 8)))),
        lambda: wrap(('div class="ad"', 'div class="advert"', 'aside class="ads"', 'div id="ad-top"', 'div class="sponsored banner"', 'section class="promo"'), r.choice((words(3, 30), paras(r.randint(1, 2), 3, 30)))),
        lambda: wrap(("aside", 'div class="sidebar"', 'div id="sidebar"', 'section class="related"', 'div class="widget"'), r.choice((paras(r.randint(1, 4), 2, 40), f"<h3>{words(1, 4)}</h3><ul>{links(4)}</ul>"))),
        lambda: wrap(('div class="cookie"', 'div id="cookie-notice"', 'div class="notice"', 'div class="banner consent"', 'div class="popup newsletter"', 'div role="alert"'), wrap(("p", "div", "span"), r.choice(("We use cookies. ", "Accept all cookies ", "Subscribe to our newsletter ", "")) + words(3, 25))),
        lambda: wrap(("form", 'form class="search"', 'div class="login"'), f"<label>{words(1, 3)}</label><input name=q>{wrap(('p', 'span'), words(1, 8))}<button>{word()}</button>"),
    ]
    comments = lambda: wrap(('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div id="disqus"'), r.choice(("", f"<h2>{words(1, 3)}</h2>")) + "".join(wrap(('div class="comment"', 'li class="reply"', "p"), paras(1, 3, 40)) for _ in range(r.randint(1, 4))))
    footer = lambda: wrap(("footer", "footer", 'div class="footer"', 'div id="footer"'), r.choice((f"&copy; {word()}.example &middot; {words(2, 30)}", f"<p>{words(2, 20)}</p>", f"<ul>{links(4)}</ul>", f"<p>&copy; {word()}</p>" + paras(1, 3, 20))))
    body = []
    if r.random() < 0.85:
        body.append(f"<h1>{MAIN}{words(1, 14)}</h1>")
    for _ in range(r.randint(1, 14)):
        x = r.random()
        size = (1, 3) if r.random() < 0.15 else (4, 120)
        if x < 0.72:
            body.append(wrap(("p",), MAIN + words(*size)) if r.random() < 0.8 else f"<p><b>{MAIN}{words(*size)}<br>")
        elif x < 0.8:
            body.append(f"<h2>{MAIN}{words(1, 8)}</h2>")
        elif x < 0.86:
            body.append("<ul>" + "".join(f"<li>{MAIN}{words(2, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif x < 0.875:
            body.append("<table>" + "".join("<tr>" + "".join(f"<{cell}>{MAIN}{words(1, 6)}</{cell}>" for _ in range(r.randint(1, 4))) + "</tr>" for cell in ("th", *["td"] * r.randint(1, 4))) + "</table>")
        elif x < 0.885:
            body.append("<dl>" + "".join(f"<dt>{MAIN}{words(1, 3)}</dt><dd>{MAIN}{words(2, 20)}</dd>" for _ in range(r.randint(1, 4))) + "</dl>")
        elif x < 0.895:
            body.append(r.choice((f"<pre>{MAIN}{words(2, 20)}</pre>", f"<pre><code>{MAIN}{words(2, 20)}</code></pre>", f"<figure><img src=x><figcaption>{MAIN}{words(1, 12)}</figcaption></figure>", f"<ol><li>{MAIN}{words(1, 4)}<li>{MAIN}{words(1, 4)}</ol>")))
        elif x < 0.9:
            body.append(f"<blockquote>{MAIN}{words(4, 40)}</blockquote>")
        elif x < 0.93:
            body.append(f"<div>{MAIN}{words(4, 60)}</div>")
        else:
            body.append(r.choice((aside[2], aside[3], aside[4]))())
    kind = r.choice(("article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post entry"', 'section class="article-body"', 'div class="main story"'))
    article = f"<{kind}>{''.join(body)}</{kind.split()[0]}>"
    if r.random() < 0.25:
        article = wrap(("main", 'div id="main"', 'div class="container"', 'div class="wrapper page"'), article + r.choice(("", comments())))
    before = [f() for f in r.sample(aside, r.randint(0, 4))]
    after = [f() for f in r.sample(aside[2:], r.randint(0, 2))] + ([comments()] if r.random() < 0.35 else []) + ([footer()] if r.random() < 0.85 else [])
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(before)}{article}{''.join(after)}" + r.choice(("</body></html>", ""))


def labelled(page: str) -> list[Block]:
    found = blocks(page)
    for b in found:
        b.main = MAIN in b.text
        b.text = b.text.replace(MAIN, "")
    return [b for b in found if b.text]


@lru_cache(maxsize=1)
def trained(n: int = PAGES, seed: int = SEED) -> Labeller:
    """The labeller; the same on every machine."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    pages = [labelled(made_page(r)) for _ in range(n)]
    net = Labeller(rng)
    net.fit([(features(p), np.array([b.main for b in p], np.float32)) for p in pages if p], rng)
    return net


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    keep = net.label([features(f) for f in found])
    return ["\n".join(b.text for b, k in zip(f, ks, strict=True) if k) for f, ks in zip(found, keep, strict=True)]


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. No shuffle."""
    common.ship(pages.sparkSession)
    net = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.reuse_memory()
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                texts = main_texts(b.column(2).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), common.text_of(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
