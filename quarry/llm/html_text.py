"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A tolerant parser turns a page into its leaf blocks, runs of text between the
borders of block elements, each with the tags, classes and ids of its ancestors.
A block's features are its ancestors' tags, groups of words in their classes and
ids, and the shape of its text: length, share in links, final punctuation, marks
of copyright. The two states are main and other; states of neighbouring blocks
are tied by transition weights. The field is trained by its exact likelihood
(forward-backward) on labelled pages and decoded by Viterbi, both for many pages
at a time.

The labelled pages are composed here from layouts that differ in what they offer
to go by (semantic tags, only class names, hardly either), so every label is
known; callers with pages of their own pass them as ``training``.

Edge cases: null and empty html, and pages without a main block, give an empty
text. Unclosed, crossed and unknown tags are tolerated: a head without an end tag
ends at the first element that can't be in it, other elements without text to read
(a button, a video) whose end tag is missing are ignored as tags, and only scripts,
styles, titles and text areas then run to the end of the page. Unknown character
references stay as they are. Whole pages are read, however long. Repeated rows
get equal results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

# Elements of HTML by their role here.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title select button canvas audio video".split())
PLAIN = frozenset("script style textarea title".split())  # of these, those in which a tag is text
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
SCOPE = frozenset("ul ol dl table html body div article section main td th menu".split())
#: Groups of words in classes and ids.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion".split(),
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe subscription paywall toast".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs toolbar".split(),
    "side": "sidebar side aside widget widgets related recommended trending tags share sharing social rail".split(),
    "head": "header masthead topbar logo branding head".split(),
    "foot": "footer foot copyright legal colophon bottom".split(),
    "comment": "comment comments reply replies respond disqus discussion reader readers".split(),
    "form": "form login signup search contact".split(),
    "main": "article content main post entry story text prose body".split(),
}
_HINT = {w: k for k, words in HINTS.items() for w in words}
_TAGS = frozenset("article main section nav footer header aside form table ul ol figure figcaption blockquote h1 h2 h3 p li pre label td dialog details address".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Block:
    __slots__ = ("hints", "linked", "main", "tags", "text")

    def __init__(self, text: str, linked: int, tags: tuple[str, ...], hints: frozenset[str], main: bool | None):
        self.text, self.linked, self.tags, self.hints, self.main = text, linked, tags, hints, main


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool | None]] = [("", frozenset(), None)]
    parts: list[str] = []
    linked = in_link = 0
    unclosed: set[str] = set()  # tags without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                _, hints, main = stack[-1]
                out.append(Block(text, linked, tuple(s[0] for s in stack[1:]), hints, main))
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal in_link
        for tag, *_ in stack[n:]:
            in_link -= tag == "a"
        del stack[n:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            linked += (size - at) * (in_link > 0)
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "head":  # holds only void and skipped elements; all else ends it
            continue
        if m[1]:
            n = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in BLOCK:
                flush()
            if n:
                if any(s[0] in BLOCK for s in stack[n:]):
                    flush()
                pop_to(n)
            continue
        if tag in RAW:
            if tag in ("svg", "math") and m[3].endswith("/"):
                continue
            end = None if tag in unclosed else _END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in PLAIN:
                at = size
            else:
                unclosed.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            n = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
            if n:  # a block element ends an open paragraph
                pop_to(n)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES.get(tag, ()):
                    pop_to(i)
                    if tag in ("li", "dt", "dd", "td", "th"):
                        break
                elif stack[i][0] in SCOPE:
                    break
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        _, hints, main = stack[-1]
        found = set()
        for a in _ATTR.finditer(m[3]) if m[3] else ():
            value = (a[2] or a[3] or a[4] or "").lower()
            if a[1].lower() == "data-main":
                main = value == "1"
            else:
                found |= {_HINT[w] for w in _WORD.findall(value) if w in _HINT}
        stack.append((tag, hints | found if found else hints, main))
        in_link += tag == "a"
    flush()
    return out


_BINS = (12, 30, 60, 120, 250, 600)


def features(b: Block) -> list[str]:
    n = len(b.text)
    share = b.linked / max(1, n)
    out = ["one", f"len{sum(n >= x for x in _BINS)}", "links-none" if share == 0 else "links-some" if share < 0.5 else "links-most"]
    out += {f"in-{t}" for t in b.tags if t in _TAGS}
    out += {f"hint-{h}" for h in b.hints}
    if b.tags:
        out.append(f"own-{next((t for t in reversed(b.tags) if t in BLOCK), 'none')}")
    if "article" not in b.tags and "main" not in b.tags and "main" not in b.hints:
        out.append("no-main-container")
    if b.text[-1] in ".!?…\"'”。":
        out.append("ends-sentence")
    if "©" in b.text or "all rights reserved" in b.text.lower():
        out.append("copyright")
    if "|" in b.text or "·" in b.text:
        out.append("separators")
    return out


class Field:
    """Two states, 1 is main. Weights: per feature and state, per transition, for the first state."""

    def __init__(self, names: list[str]):
        self.number = {f: i for i, f in enumerate(names)}
        self.emit = np.zeros((len(names) + 1, 2))  # the last row stands for unknown features and stays 0
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)

    def scores(self, pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores (page, place, state), padded, and the number of blocks of each page."""
        length = np.array([len(p) for p in pages])
        rows = [[self.number.get(f, -1) for f in features(b)] for p in pages for b in p]
        out = np.zeros((len(pages), int(length.max(initial=0)), 2))
        if rows:
            flat = self.emit[np.concatenate([np.array(r) for r in rows])]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
            page = np.repeat(np.arange(len(pages)), length)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)
            out[page, place] = np.add.reduceat(flat, at, axis=0)
        return out, length

    def viterbi(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        pages, places, _ = score.shape
        best = score[:, 0] + self.first if places else np.zeros((pages, 2))
        back = np.zeros((pages, places, 2), dtype=np.int64)
        last = best.copy()
        for t in range(1, places):
            via = best[:, :, None] + self.step[None]
            back[:, t] = via.argmax(axis=1)
            best = via.max(axis=1) + score[:, t]
            last[length > t] = best[length > t]
        state = np.zeros((pages, places), dtype=np.int64)
        now = last.argmax(axis=1)
        for t in range(places - 1, -1, -1):
            on = length > t
            state[on, t] = now[on]
            if t:
                now = np.where(on, back[np.arange(pages), t, now], now)
        return state

    def likelihood(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The log-likelihood of labels y (page, place), of which those count that are on, and its slopes, by forward-backward.

        x has a row of features for each place that is on, page by page.
        """
        page, place = np.nonzero(on)
        width = on.shape[1]
        truth = np.eye(2)[y] * on[..., None]
        score = np.zeros((*on.shape, 2))
        score[page, place] = x @ self.emit
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + self.first
        for t in range(1, width):
            alpha[:, t] = np.where(on[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + self.step, axis=1) + score[:, t], alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(on[:, t + 1, None], np.logaddexp.reduce(self.step + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + self.step + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        seen_step, seen_first = np.einsum("pti,ptj->ij", truth[:, :-1], truth[:, 1:]), truth[:, 0].sum(axis=0)
        value = (truth * score).sum() + (seen_step * self.step).sum() + seen_first @ self.first - z.sum()
        return float(value), (x.T @ (truth - node)[page, place], seen_step - edge.sum(axis=(0, 1)), seen_first - node[:, 0].sum(axis=0))

    def encoded(self, pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What likelihood() takes, of labelled pages."""
        length = np.array([len(p) for p in pages])
        x = np.zeros((int(length.sum()), len(self.number) + 1))
        for i, b in enumerate(b for p in pages for b in p):
            x[i, [self.number[f] for f in features(b)]] = 1
        on = np.arange(int(length.max())) < length[:, None]
        y = np.zeros(on.shape, dtype=np.int64)
        y[on] = [bool(b.main) for p in pages for b in p]
        return x, y, on

    def fit(self, pages: list[list[Block]], rounds: int, rate: float, decay: float) -> None:
        """Adagrad on the likelihood of the labels of all pages."""
        x, y, on = self.encoded(pages)
        weights = self.emit, self.step, self.first
        squares = [np.full_like(w, 1e-8) for w in weights]
        for _ in range(rounds):
            for w, g, s in zip(weights, self.likelihood(x, y, on)[1], squares, strict=True):
                g = g / len(pages) - decay * w
                s += g * g
                w += rate * g / np.sqrt(s)
        self.emit[-1] = 0


def labelled_pages(n: int = 400, seed: int = 5) -> list[str]:
    """Pages whose elements carry data-main="1" or "0"; the parser reads it as a label only."""
    rng = np.random.default_rng(seed)
    syllables = "ka lo mi ter an sol vu ne pra dis oui gel ba ros tin er".split()

    def words(lo: int, hi: int) -> str:
        w = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(lo, hi + 1))]
        return " ".join(w)

    def sentence(lo: int = 1, hi: int = 40) -> str:
        s = words(lo, hi)
        return s.capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.integers(lo, hi + 1)))

    def maybe(p: float, s: str) -> str:
        return s if rng.random() < p else ""

    def prose() -> str:
        out = maybe(0.8, f"<h1>{words(2, 9)}</h1>")
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            body = " ".join(sentence(1, 30) for _ in range(rng.integers(1, 7)))
            if kind < 0.72:
                out += f"<p>{maybe(0.2, '<b>')}{body}{maybe(0.2, '<br>')}" + maybe(0.8, "</p>")
            elif kind < 0.78:
                out += f'<p><a href="/x">{words(1, 3)}</a> {body}</p>'
            elif kind < 0.84:
                out += f"<h2>{words(1, 6)}</h2>"
            elif kind < 0.9:
                out += f"<ul><li>{sentence()}</li><li>{sentence()}</li></ul>"
            elif kind < 0.94:
                out += f"<blockquote>{body}</blockquote>"
            elif kind < 0.97:
                out += f"<table><tr><td>{words(1, 3)}</td><td>{rng.integers(1, 999)}</td></tr></table>"
            else:
                out += f'<div class="{rng.choice(["ad", "advert", "sponsored"])}" data-main="0">{sentence()}</div>'
        return out

    pages = []
    for _ in range(n):
        plain = rng.random() < 0.25  # class names only
        tag = (lambda t: "div") if plain else (lambda t: t)
        other = 'data-main="0"'
        name = lambda *c: f'class="{rng.choice(c)}"'
        top = maybe(0.4, f"<{tag('header')} {name('header', 'masthead', 'site-header')} {other}><p>{words(1, 5)}</p></{tag('header')}>")
        top += maybe(0.8, f"<{tag('nav')} {name('menu', 'nav', 'navbar') if plain or rng.random() < 0.5 else ''} {other}><ul>{links(2, 9)}</ul></{tag('nav')}>")
        top += maybe(0.4, f"<div {name('cookie-notice', 'consent', 'notice')} {other}><p>{sentence(4, 20)}</p></div>")
        top += maybe(0.6, f"<div {name('ad', 'ads', 'banner', 'advertisement', 'promo')} {other}>{sentence(2, 18)}</div>")
        kind = rng.random()
        if plain:
            main = f'<div {name("content", "post", "entry", "article-body", "story")} data-main="1">{prose()}</div>'
        elif kind < 0.6:
            main = f'<article data-main="1">{prose()}</article>'
        elif kind < 0.8:
            main = f'<main data-main="1">{prose()}</main>'
        elif kind < 0.9:
            main = f'<section {name("content", "main")} data-main="1">{prose()}</section>'
        else:
            main = f'<div data-main="1">{prose()}</div>'
        end = maybe(0.4, f"<{tag('aside')} {name('sidebar', 'related', 'widget')} {other}><h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul><p>{sentence(2, 25)}</p></{tag('aside')}>")
        end += maybe(0.35, f"<section {name('comments', 'comment-list', 'discussion')} id=\"comments\" {other}><h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{sentence(2, 40)}</p></div>' for _ in range(rng.integers(1, 5))) + "</section>")
        end += maybe(0.35, f"<form {name('login', 'search-form', 'newsletter', 'contact')} {other}><label>{words(1, 4)}</label><p>{sentence(2, 15)}</p></form>")
        end += maybe(0.85, f"<{tag('footer')} {name('footer', 'site-footer') if plain else ''} {other}>{maybe(0.7, '&copy; ')}{words(1, 3)}{maybe(0.5, ' &middot; ')}{sentence(1, 16)}</{tag('footer')}>")
        pages.append(f"<html><head><title>x</title></head><body>{top}{main}{end}</body></html>")
    return pages


def train(pages: list[str], rounds: int = 200, rate: float = 0.3, decay: float = 1e-4) -> Field:
    parsed = [p for p in map(blocks, pages) if p]
    field = Field(sorted({f for p in parsed for b in p for f in features(b)}))
    field.fit(parsed, rounds, rate, decay)
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract(field: Field, pages: list[str | None]) -> list[str]:
    parsed = [blocks(p) if p else [] for p in pages]
    score, length = field.scores(parsed)
    state = field.viterbi(score, length)
    return ["\n".join(b.text for b, s in zip(p, row, strict=False) if s) for p, row in zip(parsed, state, strict=True)]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = extract(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(spark: SparkSession, pages: DataFrame, *, training: list[str] | None = None) -> DataFrame:
    """Return page_id, url, text (blocks joined by a line feed) and n_chars, one row per row of pages."""
    tune(spark)
    shared = spark.sparkContext.broadcast(train(training) if training else default_field())
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_run(shared), "page_id long, url string, text string, n_chars long")


def op10_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, table(spark, sf_dir, "pages"))
