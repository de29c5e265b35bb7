"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks. A bidirectional LSTM in numpy reads,
for each block, hashed vectors of its tag path (with class and id words) and of
its words, and labels it main text or not with the whole page as context. The
network is trained on the driver, on pages made from templates.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z]+")
#: Elements whose content is never text.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "select", "option", "title")
#: What ends each of them.
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the given names.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PATH_DIM, WORD_DIM = 64, 32
HIDDEN = 20


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path with class words, text, share of characters in links) of each leaf block, in page order."""
    out, stack, parts, links = [], [], [], 0
    text_size = 0

    def flush():
        nonlocal parts, links, text_size
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                path = tuple(x for _, names in stack for x in names)
                out.append((path, text, min(1.0, links / max(1, text_size))))
        parts, links, text_size = [], 0, 0

    at, size = 0, len(page)
    in_link, endless = 0, set()
    while at < size:
        found = TOKEN.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            text_size += len(piece)
            if in_link:
                links += len(piece)
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if any(n == name for n, _ in stack):
                if name in BLOCKS:
                    flush()
                while stack:
                    gone = stack.pop()[0]
                    if gone == "a":
                        in_link -= 1
                    if gone == name:
                        break
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            # An end that is not found once is not found further on either.
            end = None if name in endless else ENDS[name].search(page, at)
            if not end:
                endless.add(name)
            at = end.end() if end else (size if name in ("script", "style") else at)
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            flush()
            for n in CLOSES.get(name, ()):
                if stack and any(x == n for x, _ in stack[-3:]):
                    while stack and stack[-1][0] != n:
                        stack.pop()
                    if stack:
                        stack.pop()
        names = [name]
        for m in NAMES.finditer(found[3] or ""):
            names += [f".{w.lower()}" for w in WORDS.findall(m[1] or m[2] or m[3] or "")]
        if not (found[3] or "").rstrip().endswith("/"):
            stack.append((name, names))
            if name == "a":
                in_link += 1
    flush()
    return out


@functools.lru_cache(65536)
def slot(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return h % dim, 1.0 if h & (1 << 20) else -1.0


def vectors(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """(blocks, features): hashed tag path (the last names weigh more), hashed words, sizes, marks, links."""
    out = np.zeros((len(page), PATH_DIM + WORD_DIM + 6), np.float32)
    for i, (path, text, linked) in enumerate(page):
        for name in dict.fromkeys(path):
            j, sign = slot(name, PATH_DIM)
            out[i, j] += sign
        for name in path[-1:]:
            j, sign = slot("last " + name, PATH_DIM)
            out[i, j] += sign
        words = text.lower().split()
        at = np.array([slot(w, WORD_DIM) for w in words])
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(at[:, 0].astype(np.int64), at[:, 1], WORD_DIM) / len(words)
        out[i, -6:] = np.log1p(len(text)) / 6, linked, text.rstrip()[-1:] in ".!?", len(words) < 6, i / max(1, len(page)), 1.0
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = 1 / np.sqrt(width + hidden)
        self.p = {f"{d}w": rng.uniform(-scale, scale, (width + hidden, 4 * hidden)) for d in "fb"}
        self.p |= {f"{d}b": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]) for d in "fb"}
        self.p |= {"ow": rng.uniform(-0.3, 0.3, 2 * hidden), "ob": np.zeros(1)}
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}

    @staticmethod
    def reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each row's first ``length`` steps in reverse order."""
        steps = np.arange(x.shape[1])
        order = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
        return x[np.arange(len(x))[:, None], order]

    def run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        h, c = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32)
        out = np.zeros((n, steps, self.hidden), np.float32)
        w, b = self.p[d + "w"], self.p[d + "b"]
        width = x.shape[2]
        given = x @ w[:width] + b
        for t in range(steps):
            z = np.hstack([x[:, t], h]) if keep is not None else None
            g = given[:, t] + h @ w[width:]
            gates = 1 / (1 + np.exp(-np.clip(g[:, : 3 * self.hidden], -30, 30)))
            i, f, o = (gates[:, k * self.hidden : (k + 1) * self.hidden] for k in range(3))
            u = np.tanh(g[:, 3 * self.hidden :])
            before, c = c, f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[:, t] = h
            if keep is not None:
                keep.append((z, i, f, o, u, before, s))
        return out

    def back(self, d: str, grad: np.ndarray, kept: list, out: dict) -> None:
        n, steps, _ = grad.shape
        dh, dc = np.zeros((n, self.hidden)), np.zeros((n, self.hidden))
        w = self.p[d + "w"]
        gw, gb = np.zeros_like(w), np.zeros_like(self.p[d + "b"])
        for t in range(steps - 1, -1, -1):
            z, i, f, o, u, before, s = kept[t]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - s * s)
            g = np.hstack([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)])
            gw += z.T @ g
            gb += g.sum(0)
            dh, dc = (g @ w.T)[:, -self.hidden :], dc * f
        out[d + "w"], out[d + "b"] = gw, gb

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        a = self.run("f", x, keep[0] if keep else None)
        b = self.reverse(self.run("b", self.reverse(x, lengths), keep[1] if keep else None), lengths)
        both = np.concatenate([a, b], axis=2)
        if keep:
            keep[2].append(both)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["ow"] + self.p["ob"], -30, 30)))

    def gradient(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> dict:
        keep = ([], [], [])
        p = self.forward(x, lengths, keep)
        mask = np.arange(x.shape[1]) < lengths[:, None]
        e = (p - y) * mask / max(1, mask.sum())
        out = {"ow": np.einsum("ntk,nt->k", keep[2][0], e), "ob": np.array([e.sum()])}
        both = e[:, :, None] * self.p["ow"]
        self.back("f", both[:, :, : self.hidden], keep[0], out)
        self.back("b", self.reverse(both[:, :, self.hidden :], lengths), keep[1], out)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    return x, lengths


# ---- pages made from templates ----------------------------------------------


def example(r: random.Random) -> str:
    """A page whose main text is marked by the letters qz at each block's start."""
    syllables = ["".join(r.choice(c) for c in ("bcdfghlmnprstv", "aeiouéäö", "lnrst ")).strip() for _ in range(30)]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: phrase(3, 16).capitalize() + r.choice((".", ".", ".", "!", "?", ""))
    para = lambda: " ".join(sentence() for _ in range(r.randint(1, 6)))
    mark = lambda t: f"qz {t}"
    style = lambda names: r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f" class='{r.choice(names)} {word()}'"))

    def links(n):
        return "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(n))

    def menu():
        body = f"<ul>{links(r.randint(2, 8))}</ul>" if r.random() < 0.8 else " | ".join(f'<a href="#">{phrase(1, 2)}</a>' for _ in range(r.randint(2, 6)))
        return f"<nav>{body}</nav>" if r.random() < 0.6 else f"<div{style(('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'topnav'))}>{body}</div>"

    def header():
        body = f"<{(h := r.choice(('h1', 'h2', 'p', 'div', 'a')))}>{phrase(1, 5)}</{h}>" + (menu() if r.random() < 0.4 else "") + (f"<p>{phrase(2, 9)}</p>" if r.random() < 0.4 else "")
        return f"<header>{body}</header>" if r.random() < 0.7 else f"<div{style(('header', 'masthead', 'banner', 'site-header', 'top'))}>{body}</div>"

    def footer():
        body = r.choice(("&copy; ", "Copyright ", "")) + f"{word()}.example.com &middot; {para()}" + (f"<p>{para()}</p>" if r.random() < 0.3 else "")
        return f"<footer>{body}</footer>" if r.random() < 0.75 else f"<div{style(('footer', 'site-footer', 'bottom', 'legal', 'colophon'))}>{body}</div>"

    def aside():
        body = r.choice((lambda: f"<h3>{phrase(1, 3)}</h3><ul>{links(r.randint(2, 6))}</ul>", lambda: f"<p>{para()}</p>", lambda: para()))()
        return f"<aside>{body}</aside>" if r.random() < 0.5 else f"<div{style(('sidebar', 'aside', 'widget', 'related', 'recommended', 'share', 'social', 'tags', 'popular', 'promo-box', 'newsletter'))}>{body}</div>"

    def advert():
        tag = r.choice(("div", "div", "section", "p"))
        return f"<{tag}{style(('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'sponsor', 'promo', 'banner-ad'))}>{para() if r.random() < 0.7 else '<p>' + para() + '</p>'}</{tag}>"

    def notice():
        return f"<div{style(('cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'subscribe', 'paywall', 'disclaimer'))}><p>{para()}</p><button>{phrase(1, 2)}</button></div>"

    def form():
        return f"<form action='/{word()}'{style(('search', 'login', 'signup', 'contact', 'subscribe')) if r.random() < 0.5 else ''}><label>{phrase(1, 4)}</label><input name='q'><p>{phrase(1, 8)}</p><button>{word()}</button></form>"

    def comments():
        each = "".join(r.choice((f"<div class='comment'><b>{word()}</b><p>{para()}</p></div>", f"<li class='comment'><p>{para()}</p></li>", f"<p>{para()}</p>", f"<article class='comment'><p>{para()}</p></article>")) for _ in range(r.randint(1, 5)))
        tag = r.choice(("div", "section", "ul"))
        return f"<{tag}{style(('comments', 'comment-list', 'replies', 'discussion', 'responses', 'disqus', 'reviews'))}>{'<h3>' + phrase(1, 3) + '</h3>' if r.random() < 0.5 else ''}{each}</{tag}>"

    def junk(text):
        kind = r.random()
        if kind < 0.1:
            return re.sub(r"(\w+)", lambda m: m[0] + r.choice(("***", "%%%", "###", "&amp;&amp;")), text)
        return text.upper() if kind < 0.18 else " | ".join(text.split()) if kind < 0.24 else text

    def body_block():
        k = r.random()
        text = junk(para())
        if k < 0.12:
            return f"<p>{mark(phrase(1, 5).capitalize())}{r.choice(('.', '', '!'))}</p>"
        if k < 0.62:
            return f"<p>{mark(text)}</p>"
        if k < 0.7:
            return f"<{(h := r.choice(('h2', 'h3')))}>{mark(phrase(1, 6))}</{h}>"
        if k < 0.77:
            return "<ul>" + "".join(f"<li>{mark(phrase(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.82:
            return f"<blockquote>{mark(text)}</blockquote>"
        if k < 0.86:
            return "<table>" + "".join(f"<tr><td>{mark(phrase(1, 4))}</td><td>{mark(phrase(1, 4))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if k < 0.9:
            return f"<pre>{mark(phrase(3, 12))}</pre>"
        if k < 0.95:
            return f"<p><a href='/x'>{mark(phrase(2, 5))}</a> {text}</p>"
        return f"<p><b>{mark(text)}<br><p>{mark(para())}</p>"

    def article():
        parts = [f"<h1>{mark(junk(phrase(1, 9)))}</h1>"] if r.random() < 0.75 else []
        if r.random() < 0.2:
            parts.append(f"<p><b>{mark(junk(para()))}<br>")
        for _ in range(r.randint(1, 9) if r.random() < 0.9 else r.randint(10, 90)):
            parts.append(body_block())
            if r.random() < 0.07:
                parts.append(r.choice((advert, aside, form, notice))())
        if r.random() < 0.08:
            parts = parts[:1] + r.choices(parts, k=r.randint(6, 40))  # pages that repeat themselves
        if r.random() < 0.08:
            return f"<article>{''.join(parts[:1])}{mark(junk(para()))}</article>"
        k = r.random()
        if k < 0.5:
            return f"<article>{''.join(parts)}</article>"
        if k < 0.65:
            return f"<main>{''.join(parts)}</main>"
        return f"<div{style(('content', 'article', 'post', 'entry-content', 'main', 'story', 'article-body', 'page-content', 'text'))}>{''.join(parts)}</div>"

    some = lambda p, f: f() if r.random() < p else ""
    out = some(0.3, header) + some(0.7, menu) + some(0.2, notice) + some(0.45, advert) + some(0.12, form) + some(0.12, aside)
    out += article()
    out += some(0.2, aside) + some(0.25, comments) + some(0.15, advert) + some(0.12, form) + some(0.12, notice) + some(0.75, footer)
    return f"<!DOCTYPE html><html><head><title>{phrase(1, 4)}</title><style>p{{}}</style></head><body>{out}</body></html>"


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(page)
    y = np.array([float("qz " in text + " ") for _, text, _ in found])
    clean = [(path, text.replace("qz ", "") or text, linked) for path, text, linked in found]
    return vectors(clean), y


@functools.cache
def trained(pages: int = 2000, steps: int = 500, batch: int = 48, seed: int = 3) -> Labeller:
    """The network, trained on made pages; the same on every call. Pages of like length are learnt together, so that little is padding."""
    r = random.Random(seed)
    data = [d for d in (labelled(example(r)) for _ in range(pages)) if len(d[1])]
    net = Labeller(data[0][0].shape[1])
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    by_length = np.argsort([len(y) for _, y in data], kind="stable")
    for t in range(1, steps + 1):
        first = rng.integers(0, max(1, len(data) - batch + 1))
        chosen = by_length[first : first + batch]
        x, lengths = padded([data[i][0] for i in chosen])
        y = np.zeros(x.shape[:2])
        for row, i in enumerate(chosen):
            y[row, : len(data[i][1])] = data[i][1]
        # Half of the pages are learnt by structure alone, so that single words weigh little.
        x[:, :, PATH_DIM : PATH_DIM + WORD_DIM] *= rng.random((len(x), 1, 1)) < 0.5
        rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in net.gradient(x, y, lengths).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def label(net: Labeller, pages: list[np.ndarray], least: float = 0.5) -> list[np.ndarray]:
    """For each page, which blocks are main text. Pages of like length run together; the batch does not change a page's labels."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and last - first < 256 and (last - first + 1) * len(pages[order[last]]) <= 16384:
            last += 1
        x, lengths = padded([pages[i] for i in order[first:last]])
        p = net.forward(x, lengths)
        for row, i in enumerate(order[first:last]):
            out[i] = p[row, : lengths[row]] >= least
        first = last
    return out


def extract(pages: DataFrame, *keep: str, html_column: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars``.

    Null and empty pages have the text "". Pages are labelled each for itself,
    whole however long they are, so repeated rows get equal texts; other columns
    are ignored; an empty table gives no rows.
    """
    net = trained()
    state, hidden = net.p, net.hidden

    def run(batches):
        own = Labeller(PATH_DIM + WORD_DIM + 6, hidden)
        own.p = state
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for first in range(0, max(1, len(column)), 512):
                parsed = [blocks(x.as_py() or "") for x in column[first : first + 512]]
                kept = label(own, [vectors(p) for p in parsed])
                texts = ["\n".join(t for (_, t, _), k in zip(p, flags) if k) for p, flags in zip(parsed, kept)]
                arrays = [c[first : first + 512] for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html_column).cast("string").alias("_html")).mapInArrow(run, f"{schema}, text string, n_chars long")
