"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: runs of inline text with the path of open elements. Every block becomes a
vector of hashed path names, hashed words and a few measures, and a bidirectional LSTM in numpy labels each
block main or not from its vector and all blocks before and after it. The weights are trained here, on
pages drawn from a grammar of layouts (``draw_page``) with known labels, never on the pages to be read;
TRAIN_PAGES bounds that sample and the seed fixes it.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.store import bounded

#: Elements that do not start a block, elements without an end, elements whose text is
#: no text once they are closed (what follows an unclosed one is text), or never; elements of a head.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom mspace merror semantics annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("template noscript object svg canvas audio video select button".split())
RAW = set("script style iframe title textarea annotation annotation-xml".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME_CLOSES = set("li dd dt tr td th option p".split())
PATH, WORD, MEASURES = 256, 32, 8
INPUT, HIDDEN = PATH + WORD + MEASURES, 20
TRAIN_PAGES, EPOCHS, SEED = 2000, 8, 3
#: Pages of more blocks are labelled alone, in bounded memory.
LONG_PAGE = 16_384
_WORD = re.compile(r"\w+")
_NAME = re.compile(r"[a-z]+")


@lru_cache(maxsize=1 << 16)
def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


class Block(NamedTuple):
    """A leaf block: counts of hashed path names, their number, text, characters inside links, element."""

    path: bytes
    names: int
    text: str
    linked: int
    tag: str


class Blocks(HTMLParser):
    """Collects the blocks of a page in order. Each tag costs the same however deep it stands: the path is kept
    as running counts of its hashed names, and open elements are found by their name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[int]]] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.solid: list[int] = []  # places of open elements that are not inline
        self.count, self.total = [0] * PATH, 0
        self.mark = bytearray(PATH)
        self.held: list[tuple[int, int]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.in_link = self.silent = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(bytes(self.mark), self.total, text, self.linked, self.open[self.solid[-1]][0] if self.solid else ""))
            self.parts = []
        self.linked = 0

    def _push(self, tag: str, slots: list[int]) -> None:
        self.where[tag].append(len(self.open))
        if tag not in INLINE:
            self.solid.append(len(self.open))
        self.open.append((tag, slots))
        self.silent += tag in RAW
        self.in_link += tag == "a"
        self.total += len(slots)
        for k in slots:
            self.count[k] += 1
            self.mark[k] = 1

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            tag, slots = self.open.pop()
            self.where[tag].pop()
            self.silent -= tag in RAW
            self.in_link -= tag == "a"
            self.total -= len(slots)
            for k in slots:
                self.count[k] -= 1
                self.mark[k] = self.count[k] > 0
        while self.solid and self.solid[-1] >= at:
            self.solid.pop()
        while self.held and self.held[-1][0] >= at:
            self.held.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if (self.open and self.open[-1][0] == "head" and tag not in IN_HEAD or tag == "body") and self.where["head"]:
            self.flush()
            self._pop(self.where["head"][0])
        if tag not in INLINE:
            self.flush()
            if self.solid:
                name = self.open[self.solid[-1]][0]
                if name == "p" and tag in CLOSES_P or name == tag and tag in SAME_CLOSES:
                    self._pop(self.solid[-1])
        if tag in VOID:
            return
        slots: list[int] = []
        if tag not in INLINE:
            names = [tag]
            for k, v in attrs:
                if v and k in ("class", "id", "role", "itemprop"):
                    names += [f".{w}" for w in _NAME.findall(v.lower())]
            slots = [_slot(n, PATH) for n in names]
        if tag in SILENT:
            self.held.append((len(self.open), len(self.blocks)))
        self._push(tag, slots)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("br",):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.where[tag]:
            return
        at = self.where[tag][-1]
        if tag not in INLINE:
            self.flush()
        elif self.solid and self.solid[-1] > at:
            return  # a stray inline end does not close blocks
        if tag in SILENT:
            while self.held[-1][0] > at:
                self.held.pop()
            del self.blocks[self.held[-1][1] :]
        self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def read_blocks(html: str | None) -> list[Block]:
    """Blocks of a page; null and pages without text have none. White space within a block is one space."""
    page = Blocks()
    page.feed(html or "")
    page.close()
    page.flush()
    return page.blocks


def vectors(blocks: list, first: int = 0, of: int | None = None) -> np.ndarray:
    """One row per block; every word of the block counts. ``blocks`` may be those from ``first`` on of a page of ``of``."""
    out = np.zeros((len(blocks), INPUT), np.float32)
    n = max(1, (of or len(blocks)) - 1)
    if blocks:
        out[:, :PATH] = np.frombuffer(b"".join(b.path for b in blocks), np.uint8).reshape(len(blocks), PATH)
    for i, (_, names, text, linked, tag) in enumerate(blocks):
        row = out[i]
        row[_slot("<" + tag, PATH)] = 1.5
        words = _WORD.findall(text.lower())
        if words:
            count = np.bincount([_slot(w, WORD) for w in words], minlength=WORD)
            row[PATH : PATH + WORD] = np.sqrt(count / len(words))
        marks = sum(text.count(c) for c in ".,;!?")
        row[PATH + WORD :] = (np.log1p(len(text)) / 6, min(1.0, linked / len(text)), min(1.0, 8 * marks / len(text)), text[-1] in ".!?…:\"»”'", len(words) < 6, (first + i) / n, min(1.0, sum(map(text.count, "|©»·")) / 2), min(3.0, names / 12))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Labeller:
    """A bidirectional LSTM with a logistic output per step, over padded batches (time, page, feature)."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = [(rng.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)) * (1.0 / np.sqrt(INPUT + HIDDEN))).astype(np.float32) for _ in range(2)]
        self.b = [np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32) for _ in range(2)]
        self.v, self.c = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32), np.zeros(1, np.float32)

    def _inputs(self, x: np.ndarray, k: int) -> np.ndarray:
        return x @ self.w[k][:INPUT] + self.b[k]

    def _pass(self, pre: np.ndarray, mask: np.ndarray, k: int, keep: bool):
        steps, pages, _ = pre.shape
        u = self.w[k][INPUT:]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, trace = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
            z = pre[t] + h @ u
            g = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            a = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            nc = m * (f * c + i * a)
            tc = np.tanh(nc)
            if keep:
                trace.append((t, h, c, f, i, o, a, tc))
            h, c = m * (o * tc), nc
            out[t] = h
        return out, trace

    def _scores(self, pre: list[np.ndarray], mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(p, mask, k, False)[0] for k, p in enumerate(pre)], axis=2)
        return _sigmoid(both @ self.v + self.c)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._scores([self._inputs(x, k) for k in (0, 1)], mask)

    def scores_of_long(self, blocks: list, part: int = 4096) -> np.ndarray:
        """The scores of one long page, whose vectors are made and projected ``part`` blocks at a time."""
        pre = [np.empty((len(blocks), 1, 4 * HIDDEN), np.float32) for _ in (0, 1)]
        for at in range(0, len(blocks), part):
            x = vectors(blocks[at : at + part], at, len(blocks))
            for k in (0, 1):
                pre[k][at : at + part, 0] = self._inputs(x, k)
        return self._scores(pre, np.ones((len(blocks), 1), np.float32))[:, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        passes = [self._pass(self._inputs(x, k), mask, k, True) for k in (0, 1)]
        both = np.concatenate([p[0] for p in passes], axis=2)
        d = (_sigmoid(both @ self.v + self.c) - y) * mask / max(1.0, mask.sum())
        grads = [None, None, None, None, np.tensordot(d, both, 2), np.array([d.sum()], np.float32)]
        for k in (0, 1):
            dout = d[:, :, None] * self.v[k * HIDDEN : (k + 1) * HIDDEN]
            u = self.w[k][INPUT:]
            dz_all, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
            dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
            for t, h0, c0, f, i, o, a, tc in reversed(passes[k][1]):
                m = mask[t][:, None]
                dh = (dh + dout[t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * c0 * f * (1 - f), dc * a * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
                dz_all[t] = dz
                du += h0.T @ dz
                dh, dc = dz @ u.T, dc * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grads[2 * k] = np.concatenate([x.reshape(-1, INPUT).T @ flat, du])
            grads[2 * k + 1] = flat.sum(0)
        return grads

    def params(self) -> list[np.ndarray]:
        return [self.w[0], self.b[0], self.w[1], self.b[1], self.v, self.c]

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 32) -> Labeller:
        p = self.params()
        m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        rng = np.random.default_rng(SEED)
        by_length = np.argsort([len(y) for _, y in pages], kind="stable")  # like lengths share a batch
        parts = np.array_split(by_length, max(1, len(pages) // batch))
        for epoch in range(epochs):
            for some in (parts[i] for i in rng.permutation(len(parts))):
                x, mask = padded([pages[i][0] for i in some])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(some):
                    y[: len(pages[i][1]), j] = pages[i][1]
                step += 1
                for a, g, m_, s_ in zip(p, self.gradients(x, mask, y), m, s, strict=True):
                    g = np.clip(g, -1, 1)
                    m_ += 0.1 * (g - m_)
                    s_ += 0.01 * (g * g - s_)
                    a -= rate / (1 + epoch) ** 0.5 * (m_ / (1 - 0.9**step)) / (np.sqrt(s_ / (1 - 0.99**step)) + 1e-8)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), INPUT), np.float32), np.zeros((steps, len(rows)), np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, 1.0
    return x, mask


#: Words and names that layouts of the training grammar use.
_CHROME = """home about contact login register subscribe newsletter search menu help terms privacy policy cookie cookies accept
settings copyright rights reserved advertisement sponsored share tweet print related more read next previous tags archive
categories follow account cart shop sitemap careers press imprint impressum datenschutz kontakt accueil inicio""".split()
_COMMENT = "reply posted says ago agree thanks great article user guest comment like report".split()
_MAIN_NAMES = ["content", "post", "entry", "article-body", "story", "main-content", "post-content", "text", "article", "body-text", "page-content", "entry-content"]
_SIDE = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "topnav", "navigation"], "header": ["header", "masthead", "site-header", "topbar", "banner", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal"], "aside": ["sidebar", "widget", "related", "rail", "recommended", "popular", "side"],
    "ad": ["ad", "ads", "advert", "sponsor", "promo", "banner-ad", "advertisement"], "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "banner", "paywall"],
    "form": ["signup", "newsletter", "search", "login", "subscribe", "form"], "comments": ["comments", "comment", "discussion", "responses", "disqus", "reader-comments", "replies"],
    "share": ["share", "social", "tools", "tags", "meta"],
}
_PARTS = "the of and re in on er an en th ti es at ed nd st le de la que ou ai der die und ein sch los ción ar es to ka mi zu vo".split()


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices(_PARTS, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(n)]


def _prose(r: random.Random, n: int) -> str:
    """Sentences, at times in odd dress: marks after words, capitals, rows of cells."""
    w, dress = _words(r, n), r.random()
    if dress < 0.08:
        w = [x + r.choice(("###", "$$$", "%%%", "&amp;&amp;&amp;", "***")) for x in w]
    elif dress < 0.12:
        w = [x.upper() + "!!" for x in w]
    elif dress < 0.16:
        return " | ".join(w)
    out = []
    for i, x in enumerate(w):
        out.append(x.capitalize() if i % 11 == 0 else x + r.choice(("", "", "", ",")) if i % 11 != 10 else x + ".")
    return " ".join(out) + ("." if r.random() < 0.85 else "")


def draw_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of the grammar and the text of its main blocks."""
    plain = r.random() < 0.15  # names say nothing
    token = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    named = lambda names: "" if plain and r.random() < 0.7 else f' {r.choice(("class", "class", "id"))}="{token() if plain else r.choice(names)}"'
    link = lambda: f'<a href="/{token()}">{" ".join(r.choices(_CHROME, k=r.choice((1, 1, 2)))).capitalize() if r.random() < 0.5 else " ".join(_words(r, r.choice((1, 1, 2, 3))))}</a>'
    main: list[str] = []

    def side(kind: str) -> str:
        tag = {"nav": ("nav", "nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "div", "section"), "form": ("form", "form", "div"), "comments": ("section", "div", "ol"), "notice": ("div", "section", "dialog"), "ad": ("div", "div", "aside"), "share": ("div", "ul")}[kind]
        tag = r.choice(tag)
        attrs = named(_SIDE[kind])
        inner = ""
        if kind == "nav":
            inner = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if r.random() < 0.7 else inner.replace("<li>", "").replace("</li>", " ")
        elif kind == "header":
            inner = r.choice((f"<h1>{' '.join(_words(r, 2)).title()}</h1>", f"<div>{link()}</div>", f"<p>{' '.join(_words(r, 5))}</p>")) + (link() if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice((f"&copy; {token()}.example &middot; {_prose(r, r.randint(3, 12))}", f"<p>&copy; 2020 {' '.join(r.choices(_CHROME, k=4))}</p>", f"<p>{_prose(r, r.randint(5, 25))}</p>" + " ".join(link() for _ in range(r.randint(1, 5)))))
        elif kind in ("ad", "notice"):
            body = _prose(r, r.randint(3, 22)) if r.random() < 0.7 else " ".join(r.choices(_CHROME, k=r.randint(3, 9)))
            inner = body if r.random() < 0.5 else f"<p>{body}</p>" + (link() if r.random() < 0.5 else "")
        elif kind == "aside":
            inner = f"<h{(h := r.choice((2, 3, 4)))}>{' '.join(_words(r, 2))}</h{h}>" + "".join(r.choice((f"<li>{link()}</li>", f"<p>{_prose(r, r.randint(4, 24))}</p>", f"<div>{link()}</div>")) for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{' '.join(r.choices(_CHROME, k=2))}</label><input name=q>" + (f"<p>{_prose(r, r.randint(3, 14))}</p>" if r.random() < 0.6 else "")
        elif kind == "comments":
            unit = lambda: r.choice((f"<p>{_prose(r, r.randint(4, 40))}</p>", f"<div{named(['comment', 'reply'])}><b>{token()}</b> {' '.join(r.choices(_COMMENT, k=2))}<p>{_prose(r, r.randint(4, 40))}</p></div>", f"<li>{_prose(r, r.randint(4, 30))}</li>"))
            inner = (f"<h3>{r.randint(1, 90)} comments</h3>" if r.random() < 0.6 else "") + "".join(unit() for _ in range(r.randint(1, 7)))
        else:
            inner = "".join(f"<span>{r.choice(_CHROME)}</span> " for _ in range(r.randint(2, 5)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def para() -> str:
        text = _prose(r, min(160, max(1, int(r.lognormvariate(3.2, 1.0)))))
        shape = r.random()
        if shape < 0.1:
            items = [_prose(r, r.randint(2, 14)) for _ in range(r.randint(2, 5))]
            main.extend(items)
            return f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{t}>"
        main.append(text)
        if shape < 0.2:
            return f"<h{(h := r.choice((2, 3)))}>{text}</h{h}>"
        if shape < 0.25:
            return f"<blockquote>{text}</blockquote>"
        if shape < 0.3:
            return f"<div>{text}</div>"
        if shape < 0.36:
            return f"<table><tr><td>{text}</td></tr></table>"
        if shape < 0.5:
            return f"<p><b>{text}<br>"
        if shape < 0.6 and " " in text:
            a, b = text.split(" ", 1)
            return f'<p><a href="/{token()}">{a}</a> {b}</p>'
        return f"<p>{text}</p>"

    title = " ".join(_words(r, r.randint(2, 12)))
    tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
    attrs = named(_MAIN_NAMES) if tag in ("div", "section") or r.random() < 0.4 else ""
    inner = ""
    if r.random() < 0.8:
        main.append(title)
        inner = f"<h1>{title}</h1>"
    if r.random() < 0.2:
        inner += side("share")
    for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20))):
        part, had = para(), len(main)
        inner += part
        if r.random() < 0.03 and main:  # one paragraph again and again
            again = r.randint(1, 12)
            inner += f"<p>{main[had - 1]}</p>" * again
            main.extend([main[had - 1]] * again)
        if r.random() < 0.05:
            inner += side(r.choice(("ad", "aside", "form", "notice")))
    if r.random() < 0.15:
        inner += side("comments")
    page = f"<{tag}{attrs}>{inner}</{tag}>"
    if tag != "main" and r.random() < 0.3:
        page = f"<main>{page}</main>"
    before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < {"nav": 0.8, "header": 0.45, "ad": 0.5}.get(k, 0.2)]
    after = [k for k in ("share", "ad", "comments", "aside", "form", "nav", "footer", "notice") if r.random() < {"footer": 0.8, "comments": 0.3, "aside": 0.35}.get(k, 0.15)]
    if r.random() < 0.3:
        r.shuffle(before)
    body = "".join(map(side, before)) + page + "".join(map(side, after))
    if r.random() < 0.3:
        body = f"<div{named(['wrapper', 'container', 'page', 'site'])}>{body}</div>"
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>', main


def drawn(count: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of grammar pages; a block is main if its text begins a main text not yet met."""
    from html import unescape

    r, out = random.Random(seed), []
    while len(out) < count:
        html, main = draw_page(r)
        blocks = read_blocks(html)
        want = [" ".join(unescape(t).split()) for t in main]
        y, at = np.zeros(len(blocks), np.float32), 0
        for i, (_, _, text, _, _) in enumerate(blocks):
            if at < len(want) and text == want[at]:
                y[i], at = 1.0, at + 1
        if at == len(want):
            out.append((vectors(blocks), y))
    return out


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller, trained once per process in a few seconds; the same on every run."""
    return Labeller().fit(drawn(TRAIN_PAGES, SEED))


def label_pages(model: Labeller, pages: list[list], limit: int = 200_000) -> list[np.ndarray]:
    """Main or not, per block of each page. Pages of like length share a batch of about ``limit`` values."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 256 and len(pages[order[end]]) * (end - at + 1) * 8 <= limit:
            end += 1
        some = order[at:end]
        if len(pages[order[at]]) > LONG_PAGE:
            out[order[at]] = model.scores_of_long(pages[order[at]]) >= 0.5
            at += 1
            continue
        x, mask = padded([vectors(pages[i]) for i in some])
        score = model.scores(x, mask)
        for j, i in enumerate(some):
            out[i] = score[: len(pages[i]), j] >= 0.5
        at = end
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): main blocks of each whole page in order, joined by one space.

    A null page, or one without main blocks, gives the empty text. Rows keep their number.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                read = [read_blocks(h.as_py()) for h in part.column(2)]
                text = [" ".join(b.text for b, keep in zip(blocks, main, strict=True) if keep) for blocks, main in zip(read, label_pages(model, read), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
