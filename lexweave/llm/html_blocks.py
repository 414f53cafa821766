"""Main text of web pages: a bidirectional LSTM over the page's blocks, in numpy.

A page becomes the sequence of its leaf blocks. A block is read as a vector of its tag path
(hashed names, classes and ids of the open block elements), of its words (hashed) and of a few
figures; the LSTM reads the whole sequence both ways, and a logistic unit labels each block as
main text or not. It is trained on pages that a seeded generator writes, with known labels:
articles in many containers, among menus, headers, footers, sidebars, notices, adverts, forms
and reader comments. Training takes seconds and depends on nothing but the seed.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexweave.llm.common import map_batches, words_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|(?=<body\b)|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>|<[/!?][^<>]*>|</?[a-zA-Z][^<>]*>""",
    re.DOTALL | re.IGNORECASE,
)
#: Elements that hold no text of the page, where they end; those of TOKEN hold no elements, and by HTML's rules go on to the page's end without their end tag.
HIDDEN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|(?=<body\b)|\Z)|<(/?)(noscript|template|head|svg|select)\b[^>]*>", re.DOTALL | re.IGNORECASE)
#: What can stand in a head.
IN_HEAD = re.compile(r"(?:\s+|<!--.*?-->|<(title|script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<(?:meta|link|base|basefont|bgsound)\b[^>]*>)*+", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
#: Elements within a block's text; all others begin a block. Fixed values.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new element of these ends an open one of the same kind.
IMPLIED = frozenset("p li dt dd tr td th option".split())
PATH_WIDE, WORD_WIDE, FIGURES, HIDDEN = 96, 48, 8, 24
WIDE = PATH_WIDE + WORD_WIDE + FIGURES
#: Blocks (pages times blocks of each) whose vectors are held at a time, and pages read side by side.
CELLS, PAGES = 1 << 14, 128


def hidden(page: str) -> dict[int, int]:
    """Start and end of the elements without text of the page. Of those that aren't closed a head ends before what can't stand in it; others are ordinary tags."""
    ends, opened = {}, {}
    for m in HIDDEN_TAG.finditer(page):
        tag = (m[3] or "").lower()
        if not tag or tag == "svg" and m[0].endswith("/>"):
            continue
        if not m[2]:
            opened.setdefault(tag, []).append(m)
        elif opened.get(tag):
            ends[opened[tag].pop().start()] = m.end()
    for m in opened.get("head", ())[:1]:
        ends[m.start()] = IN_HEAD.match(page, m.end()).end()
    return ends


@lru_cache(1 << 16)
def _path_bit(name: str) -> int:
    return 1 << zlib.crc32(f"p{name}".encode()) % PATH_WIDE


def blocks(page: str) -> list[tuple[int, str, int]]:
    """(path, text, characters in links) of each non-empty block, in page order; a path is a set of
    hashed names, as bits, so that deep pages cost no more than flat ones."""
    found, stack, opened, parts, linked, link = [], [(0, "")], Counter(), [], 0, 0

    def close():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((stack[-1][0], text, linked))
        parts, linked = [], 0

    at, ends = 0, hidden(page)
    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (link > 0)
        at = ends.get(m.start(), m.end())
        if m.start() in ends:
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[2] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        if m[2]:
            while opened[tag]:
                last = stack.pop()[1]
                opened[last] -= 1
                if last == tag:
                    break
        elif tag not in EMPTY:
            if tag in IMPLIED and stack[-1][1] == tag:
                stack.pop()
                opened[tag] -= 1
            path = stack[-1][0] | _path_bit(tag)
            for a in ATTRIBUTE.finditer(m[4]):
                for name in NAME.findall((a[2] or a[3] or a[4] or "").lower()):
                    path |= _path_bit(name)
            stack.append((path, tag))
            opened[tag] += 1
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) * (link > 0)
    close()
    return found


def vectors(some: list[tuple[int, str, int]], place: np.ndarray) -> np.ndarray:
    """A row for each block; place: where it stands in its page, from 0 to 1.

    The word part is the mean over all words of the block, each hashed whole.
    """
    x = np.zeros((len(some), WIDE), np.float32)
    if not some:
        return x
    paths = np.frombuffer(b"".join(path.to_bytes(PATH_WIDE // 8, "little") for path, _, _ in some), np.uint8)
    x[:, :PATH_WIDE] = np.unpackbits(paths.reshape(len(some), -1), axis=1, bitorder="little")
    texts = [text for _, text, _ in some]
    distinct, numbers, ends = words_of(pa.array([t.lower() for t in texts], pa.string()))
    slots = np.fromiter((zlib.crc32(w) % WORD_WIDE for w in distinct.to_pylist()), np.int64, len(distinct))[numbers]
    words = np.diff(ends)
    counts = np.bincount(np.repeat(np.arange(len(some)), words) * WORD_WIDE + slots, minlength=len(some) * WORD_WIDE)
    x[:, PATH_WIDE : PATH_WIDE + WORD_WIDE] = 4 * counts.reshape(len(some), -1) / np.maximum(1, words)[:, None]
    n, linked = (np.fromiter(v, float, len(some)) for v in (map(len, texts), (k for _, _, k in some)))
    marks = np.fromiter((sum(t.count(c) for c in ".,;:!?") for t in texts), float, len(some))
    ended, upper = (np.fromiter(v, float, len(some)) for v in ((t[-1] in ".!?:" for t in texts), (t[0].isupper() for t in texts)))
    x[:, -FIGURES:] = np.stack([np.log1p(n) / 6, np.log1p(words) / 4, np.minimum(1, linked / n), marks / (words + 1), ended, place, upper, np.ones(len(some))], axis=1)
    return x


def page_vectors(page: list[tuple[int, str, int]]) -> np.ndarray:
    return vectors(page, (np.arange(len(page)) + 0.5) / max(1, len(page)))


class Network:
    """Two LSTMs, one each way, and a logistic unit; trained by Adam through time."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (r.normal(0, 1, (WIDE + HIDDEN, 4 * HIDDEN)) / np.sqrt(WIDE + HIDDEN)).astype(np.float32)
            self.p[f"B{d}"] = np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)  # the second gate forgets
        self.p["V"] = (r.normal(0, 1, 2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str):
        """x: pages x blocks x WIDE. The states at each block, and what the way back needs."""
        pages, long, _ = x.shape
        w, b = self.p[f"W{d}"], self.p[f"B{d}"]
        given = x @ w[:WIDE] + b
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((pages, long, HIDDEN), np.float32), []
        for t in range(long) if d == "f" else range(long - 1, -1, -1):
            z = given[:, t] + h @ w[WIDE:]
            i, f, o = (self._sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out, tape

    def _back(self, x: np.ndarray, d: str, tape: list, down: np.ndarray, grad: dict) -> None:
        w = self.p[f"W{d}"]
        dh, dc = np.zeros_like(tape[0][1]), np.zeros_like(tape[0][1])
        gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"B{d}"])
        for t, h, c, i, f, o, g, tc, m in reversed(tape):
            dh = dh + down[:, t]
            own, keep = dh * m, dh * (1 - m)
            dc2 = dc * m + own * o * (1 - tc**2)
            z = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), own * tc * o * (1 - o), dc2 * i * (1 - g**2)], axis=1)
            gw[:WIDE] += x[:, t].T @ z
            gw[WIDE:] += h.T @ z
            gb += z.sum(axis=0)
            dh, dc = z @ w[WIDE:].T + keep, dc2 * f + dc * (1 - m)
        grad[f"W{d}"], grad[f"B{d}"] = gw, gb

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _read, from given states and without the tape; the last states too."""
        w, b = self.p[f"W{d}"], self.p[f"B{d}"]
        given, out = x @ w[:WIDE] + b, np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = given[:, t] + h @ w[WIDE:]
            gates, m = self._sigmoid(z[:, : 3 * HIDDEN]), mask[:, t, None]
            c2 = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
            h, c = m * gates[:, 2 * HIDDEN :] * np.tanh(c2) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out, h, c

    def main_text(self, pages: list[list[tuple[int, str, int]]], cells: int = CELLS) -> list[np.ndarray]:
        """For each page of blocks whether each is main text.

        The pages are read side by side in windows of at most `cells` blocks, first to last and
        back; from window to window go the networks' states alone, so that memory is bounded by
        `cells` whatever the pages' lengths, and the outcome doesn't depend on the windows.
        """
        long = max(map(len, pages))
        step = max(1, cells // len(pages))
        odds = np.full((len(pages), long), self.p["c"][0], np.float32)
        starts, last = range(0, long, step), None

        def window(a: int) -> tuple[np.ndarray, np.ndarray]:
            own = [p[a : a + step] for p in pages]
            wide = min(step, long - a)
            x, mask = np.zeros((len(pages), wide, WIDE), np.float32), np.zeros((len(pages), wide), np.float32)
            place = np.concatenate([(a + np.arange(len(o)) + 0.5) / max(1, len(p)) for o, p in zip(own, pages, strict=True)])
            rows, begin = vectors([b for o in own for b in o], place), 0
            for k, o in enumerate(own):
                x[k, : len(o)], mask[k, : len(o)] = rows[begin : begin + len(o)], 1
                begin += len(o)
            return x, mask

        for d, order, v in (("f", starts, self.p["V"][:HIDDEN]), ("b", reversed(starts), self.p["V"][HIDDEN:])):
            h = c = np.zeros((len(pages), HIDDEN), np.float32)
            for a in order:
                if last is None or last[0] != a:
                    last = a, window(a)
                out, h, c = self._scan(*last[1], d, h, c)
                odds[:, a : a + step] += out @ v
        return [odds[k, : len(p)] >= 0 for k, p in enumerate(pages)]

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 5, size: int = 24, rate: float = 0.01, seed: int = 9) -> Network:
        r, step = np.random.default_rng(seed), 0
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for k in range(0, len(order), size):
                x, mask = padded([pages[i][0] for i in order[k : k + size]])
                y = np.zeros(mask.shape, np.float32)
                for row, i in enumerate(order[k : k + size]):
                    y[row, : len(pages[i][1])] = pages[i][1]
                (hf, tf), (hb, tb) = self._read(x, mask, "f"), self._read(x, mask, "b")
                both = np.concatenate([hf, hb], axis=2)
                e = (self._sigmoid(both @ self.p["V"] + self.p["c"]) - y) * mask / mask.sum()
                grad = {"V": (both * e[..., None]).sum(axis=(0, 1)), "c": np.array([e.sum()], np.float32)}
                down = e[..., None] * self.p["V"]
                self._back(x, "f", tf, down[..., :HIDDEN], grad)
                self._back(x, "b", tb, down[..., HIDDEN:], grad)
                step += 1
                for name, g in grad.items():
                    one[name] = 0.9 * one[name] + 0.1 * g
                    two[name] = 0.999 * two[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - rate * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    long = max(map(len, pages))
    x, mask = np.zeros((len(pages), long, WIDE), np.float32), np.zeros((len(pages), long), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


#: How written pages name the parts of a page. Fixed values.
ARTICLE = ("article", "article", "article", "main", "div class='content'", "div class='post-content'", "div id='content'", "div class='entry'", "div class='story body'", "section class='article-body'", "div role='main'", "div class='text'", "div class='page'", "td class='main'", "div")
ASIDE = {
    "menu": ("nav", "div class='nav'", "div class='menu'", "ul class='navigation'", "div id='navbar'", "div class='breadcrumb'", "nav class='pagination'"), "top": ("header", "div class='header'", "div id='masthead'", "div class='banner'"),
    "foot": ("footer", "div class='footer'", "div id='footer'", "div class='copyright'"), "side": ("aside", "div class='sidebar'", "div class='related'", "div class='widget'", "div class='recommended'", "section class='more links'"),
    "note": ("div class='cookie notice'", "div class='alert'", "div class='notice'", "div role='alert'", "div class='gdpr consent'", "div class='popup'"), "ad": ("div class='ad'", "div class='advert'", "div class='sponsored'", "div class='promo'", "ins class='ads'", "div id='banner ad'"),
    "form": ("form", "form class='search'", "div class='newsletter'", "div class='subscribe'", "form id='login'"), "talk": ("div class='comments'", "section id='comments'", "ol class='comment list'", "div class='comment'", "div class='discussion replies'", "div class='reader comments'"),
    "share": ("div class='share'", "div class='social'", "div class='tags'", "div class='meta byline'"),
}


def written_page(r: np.random.Generator) -> tuple[str, list[int]]:
    """A page, and for each of its blocks whether it is main text."""
    labels: list[int] = []
    syllables = ["".join(r.choice(list("bcdfghklmnprstv"), 1)) + "".join(r.choice(list("aeiouéèäöüñó"), 1, p=[0.13] * 5 + [0.05] * 7)) + "".join(r.choice(["", "n", "r", "s", "t"], 1)) for _ in range(40)]
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))

    def sentence() -> str:
        """Mostly prose, from one word on; some with signs, capitals, separators or repeats, in any part of a page."""
        u, text = r.random(), words(int(r.integers(1, 18)))
        if u < 0.06:
            text = text.replace(" ", str(r.choice(["### ", "%%% ", "!! ", " | ", "&amp;&amp;&amp; "])))
        elif u < 0.09:
            text = text.upper()
        elif u < 0.12:
            text = " ".join([word()] * int(r.integers(3, 40)))
        elif u < 0.15:
            text += f" {word()}@{word()}.org {r.integers(10, 10**9)} https://{word()}.com/{word()}"
        return text.capitalize() + str(r.choice([".", ".", ".", "", "\n"]))

    def block(text: str, label: int, tag: str) -> str:
        labels.append(label)
        return f"<{tag}>{text}</{tag}>"

    def paragraph(label: int) -> str:
        return block(" ".join(sentence() for _ in range(int(r.choice([1, 1, 2, 3, 5, 12])))), label, "p")

    def links(n: int) -> str:
        return "<ul>" + "".join(block(f"<a href='/{word()}'>{words(int(r.integers(1, 4)))}</a>", 0, "li") for _ in range(n)) + "</ul>"

    def other(kind: str) -> str:
        opened = str(r.choice(ASIDE[kind]))
        if kind in ("menu", "side") and r.random() < 0.8:
            inner = (block(words(2), 0, "h3") if r.random() < 0.3 else "") + links(int(r.integers(2, 8)))
        elif kind == "talk":
            inner = "".join((block(words(2), 0, "h4") if r.random() < 0.5 else "") + paragraph(0) for _ in range(int(r.integers(1, 5))))
        elif kind == "form":
            inner = block(words(3), 0, "p") + (block(sentence(), 0, "p") if r.random() < 0.5 else "")
        elif r.random() < 0.5:
            labels.append(0)
            inner = " ".join(sentence() for _ in range(int(r.integers(1, 4))))
        else:
            inner = "".join(paragraph(0) for _ in range(int(r.integers(1, 3))))
        return f"<{opened}>{inner}</{opened.split()[0]}>"

    def article() -> str:
        opened, inner = str(r.choice(ARTICLE)), ""
        if r.random() < 0.8:
            inner += block(words(int(r.integers(2, 12))).capitalize() + str(r.choice(["", "."])), 1, str(r.choice(["h1", "h1", "h2"])))
        for _ in range(int(r.integers(1, 12))):
            u = r.random()
            if u < 0.72:
                inner += paragraph(1)
            elif u < 0.8:
                inner += block(words(int(r.integers(2, 6))).capitalize(), 1, "h2")
            elif u < 0.86:
                inner += "<ul>" + "".join(block(sentence(), 1, "li") for _ in range(int(r.integers(2, 5)))) + "</ul>"
            elif u < 0.9:
                inner += "<blockquote>" + paragraph(1) + "</blockquote>"
            elif u < 0.94:
                inner += "<table><tr>" + "".join(block(words(2), 1, "td") for _ in range(int(r.integers(2, 5)))) + "</tr></table>"
            else:
                inner += other(str(r.choice(["ad", "side", "share", "note", "form"])))
        return f"<{opened}>{inner}</{opened.split()[0]}>"

    page = ""
    for kind in ("top", "menu", "note", "ad", "form", "side"):
        page += other(kind) if r.random() < 0.45 else ""
    page += article()
    for kind in ("share", "talk", "side", "form", "ad", "foot"):
        page += other(kind) if r.random() < 0.45 else ""
    return f"<html><head><title>{words(4)}</title></head><body>{page}</body></html>", labels


@lru_cache(1)
def trained(pages: int = 900) -> Network:
    r, made = np.random.default_rng(3), []
    for _ in range(pages):
        page, labels = written_page(r)
        found = blocks(page)
        if len(found) == len(labels) and found:
            made.append((page_vectors(found), np.array(labels, np.float32)))
    return Network().train(made)


def extract(pages: DataFrame, network: Network | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; a map over partitions.

    Null and empty pages, and pages without a block of main text, give an empty text; repeated
    rows are read each; an empty table gives no rows; other columns are ignored. A very long page
    is read whole, in windows, so that a task holds its blocks' texts and CELLS vectors.
    """
    network = network or trained()
    sent = pages.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            found = [blocks(p or "") for p in batch.column("html").to_pylist()]
            out = [""] * len(found)
            order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
            while order:  # pages of like lengths side by side, no more than their longest lets into CELLS
                some = order[-max(1, min(PAGES, CELLS // len(found[order[-1]]))) :]
                del order[-len(some) :]
                for k, keep in zip(some, sent.value.main_text([found[k] for k in some]), strict=True):
                    out[k] = "\n".join(text for (_, text, _), main in zip(found[k], keep, strict=True) if main)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
