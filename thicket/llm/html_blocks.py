"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the runs of text between block-level tags.  Each block is a vector of its hashed tag path
(names, classes and ids of its ancestors), all its words, hashed, and a few shape values (length, share of link text, place).
A bidirectional LSTM in numpy reads a page's blocks in order and labels every one with the whole page in view; blocks
labelled main text are joined in page order.

The labeller is trained here, with Adam, on TRAIN_PAGES generated pages of known labels: articles in many containers,
with menus, headers, breadcrumbs, sidebars, adverts, notices, forms, reader comments, related links and footers around
and inside them.  Training is seeded, so every run has the same model.

Text inside script, style, noscript, template, svg, select, option, button, textarea, title and comments is never a block.
Character references are decoded; white space inside a block becomes one space.  Null or empty html gives an empty text;
unclosed, stray and cut-off tags are read as browsers do as far as blocks are concerned.  Reading a page takes time in
proportion to its length, however deep or malformed it is, and a long page is read whole.  Every row is read on its own:
rows that repeat come out as often; a score of exactly 0 is not main text; an empty table gives an empty result; columns
other than the html and those kept are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, texts_of, tidy

PATH, WORDS, SHAPE = 128, 48, 8
WIDTH = PATH + WORDS + SHAPE
HIDDEN = 24
TRAIN_PAGES, EPOCHS, SEED = 2_400, 8, 20
BATCH = 256

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
# fixed values of the HTML standard
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg select option button textarea title iframe object math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SPACE = re.compile(r"\s+")
_END = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I) for tag in SILENT}
#: Names nearest to a block that weigh fully.
NEAR = 6


@functools.lru_cache(1 << 16)
def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


#: What the made-up words of training pages are put together from.
SYLLABLES = [a + b for a in "etaonrishdlucmwfgypbvké" for b in "aeiouêäntr"]


@dataclass
class Block:
    """path: the names (tags, classes and ids of ancestors) nearest to the block, the nearest last, or all of them;
    above: how often each slot of PATH has a name, over all ancestors, if path is cut."""

    text: str
    path: list[str]
    linked: int = 0
    label: int = 0
    above: np.ndarray | None = None


def _names(tag: str, attributes: str) -> list[str]:
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        out += [f".{p}" for p in _PART.findall((m[2] or m[3] or m[4] or "").lower())]
    return out


class _Scanner:
    """The tags of a page, each read once: no place is looked at more often than a fixed number of times, whatever is
    unclosed."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "\"'>"}

    def find(self, c: str, at: int) -> int:
        """The next c, or -1; no search goes past the last one."""
        return self.html.find(c, at) if at <= self.last[c] else -1

    def tag_end(self, at: int) -> tuple[int, int]:
        """End of the attributes that begin here, and of the tag.  A quote that is never closed is a character like any
        other; a tag that is never closed ends with the page."""
        start = at
        while True:
            at = _PLAIN.match(self.html, at).end()
            if at >= len(self.html):
                break
            if self.html[at] == ">":
                return at, at + 1
            if (closing := self.find(self.html[at], at + 1)) < 0:
                break
            at = closing + 1
        end = self.find(">", start)
        return (end, end + 1) if end >= 0 else (len(self.html), len(self.html))


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in order, in time linear in the page."""
    scan, size = _Scanner(html), len(html)
    stack: list[tuple[str, list[str]]] = []
    opened: Counter[str] = Counter()
    counts = np.zeros(PATH, dtype=np.int32)
    found: list[Block] = []
    pieces: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
        if text:
            near: list[str] = []
            for _, names in reversed(stack):
                near = names[max(0, len(names) - NEAR + len(near)) :] + near
                if len(near) >= NEAR:
                    break
            found.append(Block(text, near, min(linked, len(text)), 0, counts.astype(np.float32)))
        pieces.clear()
        linked = 0

    def push(tag: str, names: list[str]) -> None:
        stack.append((tag, names))
        opened[tag] += 1
        for n in names:
            counts[_slot(n, PATH)] += 1

    def pop() -> str:
        tag, names = stack.pop()
        opened[tag] -= 1
        for n in names:
            counts[_slot(n, PATH)] -= 1
        return tag

    at = 0
    while at < size:
        m = _OPEN.search(html, at)
        stop = m.start() if m else size
        if stop > at:
            pieces.append(html[at:stop])
            linked += stop - at if links else 0
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            end = html.find("-->", at) if m[0] == "<!--" else scan.find(">", at)
            at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        tag = m[2].lower()
        start = at
        stop, at = scan.tag_end(at)
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and opened[tag]:
                close()
                while pop() != tag:
                    pass
            continue
        if tag in SILENT:
            if html[stop - 1] != "/":
                end = _END[tag].search(html, at)
                at = scan.tag_end(end.end())[1] if end else size
            pieces.append(" ")
            continue
        if tag == "br":
            pieces.append(" ")
        if tag == "a":
            links += 1
        if tag in INLINE:
            continue
        close()
        links = 0
        if tag in CLOSES_P and stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop()
        if tag not in VOID:
            push(tag, _names(tag, html[start:stop]))
    close()
    return found


def vectors(page: list[Block]) -> np.ndarray:
    """len(page) x WIDTH features."""
    x = np.zeros((len(page), WIDTH), dtype=np.float32)
    for k, b in enumerate(page):
        row = x[k]
        near = b.path[max(0, len(b.path) - NEAR) :]
        if b.above is not None:
            row[:PATH] = b.above / 2
        for name in b.path if b.above is None else ():
            row[_slot(name, PATH)] += 0.5
        for name in near:
            row[_slot(name, PATH)] += 0.5
        words = b.text.lower().split(" ")
        for w in words:
            row[PATH + _slot(w.strip(".,:;!?\"'()"), WORDS)] += 1.0
        row[PATH : PATH + WORDS] /= float(np.sqrt(len(words)))
        n = len(b.text)
        row[PATH + WORDS :] = (
            np.log1p(n) / 6,
            b.linked / n,
            min(len(words), 60) / 60,
            b.text[-1] in ".!?\"'»”",
            k / max(1, len(page) - 1),
            b.text.count("|") + b.text.count("·") + b.text.count("©") > 0,
            len(page) < 12,
            1.0,
        )
    np.minimum(x[:, :PATH], 3.0, out=x[:, :PATH])
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """One bidirectional LSTM layer and a logistic output; batches are time x pages x features."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (r.standard_normal((WIDTH, 4 * h)) * 0.15).astype(np.float32)
            self.p["h" + d] = (r.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["o"] = (r.standard_normal((2 * h + WIDTH,)) * 0.1).astype(np.float32)
        self.p["oc"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        t, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((t, n, HIDDEN), np.float32)
        pre = (x.reshape(-1, WIDTH) @ self.p["x" + d] + self.p["c" + d]).reshape(t, n, 4 * HIDDEN)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[k] + h @ self.p["h" + d]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((k, h, c, i, f, o, g, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[k] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        a = self._run(x, mask, "f", keep.setdefault("f", []) if keep is not None else None)
        b = self._run(x, mask, "b", keep.setdefault("b", []) if keep is not None else None)
        every = np.concatenate([a, b, x], axis=2)
        if keep is not None:
            keep["every"] = every
        return every @ self.p["o"] + self.p["oc"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        z = self.logits(x, mask, keep)
        prob = sigmoid(z)
        n = mask.sum()
        loss = -float((mask * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / n)
        dz = mask * (prob - y) / n
        g = {"o": np.einsum("tn,tnd->d", dz, keep["every"]), "oc": dz.sum().reshape(1)}
        top = dz[:, :, None] * self.p["o"]
        flat = x.reshape(-1, WIDTH)
        for d, part in (("f", top[:, :, :HIDDEN]), ("b", top[:, :, HIDDEN : 2 * HIDDEN])):
            dpre = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            g["h" + d] = np.zeros_like(self.p["h" + d])
            for k, h0, c0, i, f, o, gg, tanh, m in reversed(keep[d]):
                dh = dh + part[k]
                live = dh * m
                dnew = live * o * (1 - tanh**2) + dc * m
                dzk = np.concatenate([dnew * gg * i * (1 - i), dnew * c0 * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - gg**2)], axis=1)
                dpre[k] = dzk
                g["h" + d] += h0.T @ dzk
                dh = dzk @ self.p["h" + d].T + dh * (1 - m)
                dc = dnew * f + dc * (1 - m)
            flat_d = dpre.reshape(-1, 4 * HIDDEN)
            g["x" + d] = flat.T @ flat_d
            g["c" + d] = flat_d.sum(axis=0)
        return loss, g

    def fit(self, pages: list[list[Block]], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01) -> float:
        r = random.Random(seed)
        data = sorted(((vectors(p), np.array([b.label for b in p], np.float32)) for p in pages if p), key=lambda z: len(z[1]))
        groups = [data[k : k + 30] for k in range(0, len(data), 30)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            r.shuffle(groups)
            for group in groups:
                x, mask = padded([a for a, _ in group])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(group):
                    y[: len(labels), k] = labels
                loss, g = self.gradients(x, mask, y)
                step += 1
                now = rate * (1 - epoch / (epochs + 1))
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length go through together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            # a bound on time x pages keeps memory the same for pages of any length
            longest = len(pages[order[min(at + BATCH, len(order)) - 1]])
            take = order[at : at + max(1, min(BATCH, 40_000 // longest))]
            x, mask = padded([vectors(pages[k]) for k in take])
            z = self.logits(x, mask)
            for j, k in enumerate(take):
                out[k] = z[: len(pages[k]), j] > 0
            at += len(take)
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, rows))
    x, mask = np.zeros((t, len(rows), WIDTH), np.float32), np.zeros((t, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


class Generator:
    """Pages of known labels.  The words of articles are made up, so that only structure, shape and the usual words of
    the parts around an article tell them apart."""

    LABELS = {
        "menu": "Home|News|About us|Contact|Products|Blog|Login|Sign up|Sports|World|Politics|Search|Archive|Help|FAQ|Shop|Startseite|Über uns|Accueil|Inicio".split("|"),
        "notice": "We use cookies to improve your experience.|By continuing you accept our cookie policy.|Accept all cookies|Please enable JavaScript to view this page.|This site uses cookies. Read our privacy policy.|Subscribe now to read on|You are using an outdated browser.".split("|"),
        "form": "Enter your email|Subscribe to our newsletter|Your name|Search this site|Send|Leave a reply|Password|Your e-mail address will not be published|Sign up for updates".split("|"),
        "footer": "All rights reserved|Terms of use|Privacy policy|Imprint|Powered by|Back to top|Contact us|Sitemap|Impressum|Datenschutz|Mentions légales".split("|"),
        "share": "Share|Tweet|Print|Email this|Share on social media|Like|Follow us|Copy link".split("|"),
        "related": "Related articles|You may also like|More from this author|Read next|Trending now|Most read|Recommended for you|Popular posts".split("|"),
    }
    ROLES = {
        "menu": ["nav", "div class='menu'", "div id='nav'", "ul class='navbar'", "div class='navigation top'", "div role='navigation'", "div class='breadcrumb'", "ul class='breadcrumbs'", "div class='topbar'"],
        "header": ["header", "div class='header'", "div id='masthead'", "div class='site-header'", "div class='banner-top'", "div id='header'"],
        "ad": ["div class='ad'", "div class='advert'", "div class='ads banner'", "aside class='promo'", "div class='sponsored'", "div id='ad-1'", "div class='advertisement'", "section class='promotion'", "ins class='adsbygoogle'", "div class='ad-slot'"],
        "side": ["aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "section class='widget-area'", "div class='related'", "div class='recommended'", "aside class='sidebar'", "div class='side-column'"],
        "notice": ["div class='cookie-notice'", "div id='cookie-banner'", "div class='notice'", "div class='alert'", "div class='consent'", "div class='popup modal'", "section class='notification'", "div class='gdpr'", "div role='alert'"],
        "form": ["form", "form class='search'", "form id='newsletter'", "div class='subscribe'", "form class='comment-form'", "div class='newsletter signup'", "fieldset"],
        "comments": ["section id='comments'", "div class='comments'", "div class='comment-list'", "ol class='commentlist'", "div id='disqus'", "section class='comments'", "div class='reader-comments'", "div class='responses'", "div class='comment'"],
        "footer": ["footer", "div class='footer'", "div id='footer'", "div class='site-footer'", "div class='copyright'", "div class='legal'"],
        "share": ["div class='share'", "div class='social'", "ul class='share-buttons'", "div class='byline-tools'"],
    }
    ARTICLES = ["article", "main", "div class='content'", "div id='content'", "div class='post'", "div class='entry-content'", "div class='article-body'", "section class='article'", "div class='story'", "main article", "div class='main' article", "div role='main'", "td", "div class='text'", "article class='post'"]
    WRAPS = ["", "", "", "div", "div class='wrapper'", "div class='container'", "div id='page'", "div class='row' div class='col'"]

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 5)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        r = self.r
        style = r.random()
        end = r.choice(["", " "]) + r.choice("*%#~=+^_$@&") * r.randint(1, 4) if style < 0.05 else ""
        words = [self.word() + end for _ in range(r.randint(low, high))]
        text = r.choice([" | ", " - ", " / ", " :: ", ", "]).join(words) if 0.05 <= style < 0.15 else " ".join(words)
        if style > 0.95:
            return text.upper() + "!!"
        return text[:1].upper() + text[1:] + r.choice([".", ".", ".", "?", "!", ""])

    def paragraph(self) -> str:
        n = self.r.choice([1, 1, 2, 3, 5, 8])
        if self.r.random() < 0.03:
            return " ".join([self.word() + self.r.choice(["", ","])] * self.r.randint(5, 80))
        return " ".join(self.sentence(1 if n == 1 else 4) for _ in range(n))

    def opened(self, spec: str) -> tuple[str, str]:
        parts = re.findall(r"[a-z0-9]+(?: (?:class|id|role)='[^']*')*", spec)
        return "".join(f"<{p}>" for p in parts), "".join(f"</{p.split(' ')[0]}>" for p in reversed(parts))

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.choice([0, 0, 1, 2])):
            k, tag = self.r.randrange(len(words)), self.r.choice(["b", "i", "em", "strong", "a href='/x'", "span"])
            words[k] = f"<{tag}>{words[k]}</{tag.split(' ')[0]}>"
        return " ".join(words)

    def part(self, role: str) -> str:
        """A part that isn't main text."""
        r = self.r
        a, b = self.opened(r.choice(self.ROLES[role]))
        known = self.LABELS.get({"header": "menu", "side": "related", "ad": "related", "comments": "form"}.get(role, role), [])
        links = [f"<a href='/{k}'>{r.choice([self.word(), self.word(), r.choice(known) if known else self.word()])}</a>" for k in range(r.randint(2, 9))]
        if role in ("menu", "header", "share") or role == "footer" and r.random() < 0.4 or role == "side" and r.random() < 0.5:
            kind = r.random()
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if kind < 0.5 else "".join(f"<li>{x}</li>" for x in links) if kind < 0.6 else r.choice([" | ", " ", " &middot; "]).join(links)
            body = (f"<h{r.choice('2342341')}>{self.sentence(1, 3)}</h3>" if role in ("header", "side") and r.random() < 0.6 else "") + body
        elif role == "form":
            body = f"<label>{r.choice(known)}</label><input type='text'><p>{r.choice(known)}</p>" + (f"<p>{self.sentence()}</p>" if r.random() < 0.3 else "")
        elif role == "comments":
            tag = r.choice(["p", "div class='comment'", "li", "div class='comment-body'", "p", "article class='comment'"])
            c, d = self.opened(tag)
            body = (f"<h3>{r.randint(1, 60)} comments</h3>" if r.random() < 0.6 else "") + "".join(f"{c}{r.choice(['', f'<b>{self.word()}</b> ', f'<span>{self.word()} says:</span> '])}{self.inline(self.paragraph())}{d}" for _ in range(r.randint(1, 6)))
        elif role == "footer":
            body = r.choice(["&copy; ", "&copy; 2024 ", "© ", ""]) + r.choice([f"{self.word()}.example.com &middot; {self.sentence(2, 8)}", r.choice(known), f"{self.word()} {r.choice(known)}", f"<p>{self.sentence(2, 9)}</p><p>{r.choice(known)}</p>"])
        elif role == "notice":
            body = r.choice([r.choice(known), f"<p>{r.choice(known)}</p>", f"<p>{self.sentence()}</p><p>{r.choice(known)}</p>", self.sentence()])
        else:
            body = r.choice([self.sentence(3, 12), f"<p>{self.sentence(3, 12)}</p>", f"<h4>{r.choice(known) if known else self.word()}</h4><p>{self.paragraph()}</p>", f"<p>{self.paragraph()}</p><p>{self.paragraph()}</p>", f"<a href='/ad'>{self.sentence(2, 6)}</a>"])
        return a + body + b

    def page(self) -> list[Block]:
        """The blocks of a generated page.  Main text is marked by a sign that is taken out again."""
        r = self.r
        sign = "␂"
        main = []
        if r.random() < 0.85:
            main.append(f"<h1>{sign}{self.sentence(2, 10)}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            text = sign + self.inline(self.paragraph())
            if kind < 0.72:
                main.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.78:
                main.append(f"<h{r.choice('23')}>{sign}{self.sentence(1, 6)}</h2>")
            elif kind < 0.84:
                main.append("<ul>" + "".join(f"<li>{sign}{self.inline(self.sentence(2, 12))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.88:
                main.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.92:
                main.append(f"<p><b>{text}<br>")
            elif kind < 0.95:
                main.append(f"<div>{text}</div>")
            else:
                main.append(f"<pre>{text}</pre>")
        if r.random() < 0.06:
            # the same short paragraph many times over
            at = r.randrange(len(main) + 1)
            main[at:at] = [f"<p>{sign}{self.sentence(1, 6)}</p>"] * r.randint(5, 80)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            main.insert(r.randrange(len(main) + 1), self.part(r.choice(["ad", "share", "side", "notice", "form", "ad"])))
        if r.random() < 0.15:
            main.append(self.part("comments"))
        a, b = self.opened(r.choice(self.ARTICLES))
        before = [self.part(x) for x in ("notice", "header", "menu", "menu", "ad", "side", "form") if r.random() < (0.6 if x == "menu" else 0.3)]
        after = [self.part(x) for x in ("share", "side", "comments", "form", "ad", "footer", "footer", "notice") if r.random() < (0.75 if x == "footer" else 0.25)]
        c, d = self.opened(r.choice(self.WRAPS) or "div") if r.random() < 0.5 else ("", "")
        html = "<html><head><title>t</title></head><body>" + "".join(before) + c + a + "".join(main) + (b if r.random() < 0.95 else "") + d + "".join(after) + "</body></html>"
        found = blocks(html)
        for x in found:
            x.label = int(sign in x.text)
            x.text = x.text.replace(sign, "").strip() or "x"
        return found


@functools.lru_cache(1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    generator = Generator(seed)
    model = Labeller(seed)
    model.fit([generator.page() for _ in range(pages)], epochs, seed)
    return model


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Labeller | None = None) -> DataFrame:
    """One row per row of df: the columns in `keep`, text and n_chars."""
    shared = df.sparkSession.sparkContext.broadcast((model or trained()).p)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = shared.value
        last = len(keep)
        for batch in batches:
            for start, stop in byte_chunks(batch.column(last), rows=1000):
                pages = [blocks(t) for t in texts_of(batch.column(last), start, stop)]
                texts = ["\n\n".join(b.text for b, good in zip(p, marks, strict=True) if good) for p, marks in zip(pages, labeller.label(pages), strict=True)]
                columns = [batch.column(k).slice(start, stop - start) for k in range(last)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*[F.col(c) for c in keep], F.col(html)).mapInArrow(tidy(read), f"{schema}, text string, n_chars long")
