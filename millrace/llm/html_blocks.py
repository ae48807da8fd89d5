"""Main text of web pages: a bidirectional LSTM in numpy labels every block with its whole page in view.

A page is cut into leaf blocks at block-level tags; each block becomes a vector of its tag path (hashed
tags and class or id words), its hashed words and a few measures. The network reads the sequence both ways and
tells article from everything else. It is trained here, on pages made from a parameterised layout generator
and on a bounded sample of the table's own pages whose markup names the article.

What is no text of a page is left out as browsers do: scripts, styles and comments up to their end (or the page's), titles, the head
up to the first tag that can't stand in it, drawings up to their end or the next block, templates that are closed. What browsers
without scripts show (``noscript``) is blocks like others.

Defined cases: null and empty html give empty text; a page without article blocks gives empty text; unclosed tags
and cut-off pages are read as far as they go; character references are decoded after blocks are cut; pages of any length are
read whole; repeated rows are answered each for themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_pandas
from millrace.llm.common import table

#: Sizes of the hashed path and word vectors, of the state of each direction, and bounds of the training pages.
PATH, WORDS, HIDDEN = 256, 32, 16
GENERATED, SAMPLED, EPOCHS = 400, 200, 5
#: Blocks of the table's pages from which on they are no training pages; the network reads pages of any length.
LONGEST = 400
#: Pages labelled at once.
AT_ONCE = 256
_MEASURES = 6
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html iframe label legend li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead tr ul".split()
)
#: What may stand in a head; any other tag ends it.
HEAD_TAGS = frozenset("base head html link meta noscript script style template title".split())
#: Groups: 1 raw text's tag, 2 slash, 3 tag, 4 attributes, 5 text. Quotes count after an equals sign only.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)\b(?>[^>]*)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?>[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|([^<]+)|<",
    re.S | re.I,
)
_TEMPLATE_END = re.compile(r"</template\s*>", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _name_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = (a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple(dict.fromkeys(w.lower() for x in found for w in _PIECES.findall(x)))


class Block:
    """A leaf of the page: where it stands, what it says, and how much of that is links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order; scripts, styles, head, comments and markup are left out."""
    out: list[Block] = []
    path: list[tuple] = []  # (tag, words of class and id)
    parts: list[str] = []
    linked = anchor = 0
    hidden, depth = "", 0  # what holds text that isn't the page's: head, title, svg or template
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(path), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        tag, text = m[3], m[5]
        if text is None and tag is None:
            if m[0] != "<":
                continue  # scripts, styles, comments
            text = "<"
        if text is not None:
            if hidden == "head" and not text.isspace():
                hidden = ""
            if not hidden:
                parts.append(text)
                if anchor:
                    linked += len(text.strip())
            continue
        tag, ends, closed = tag.lower(), bool(m[2]), m[4].endswith("/")
        if hidden == "title":
            hidden = ""  # at its end, or where another tag shows that the end is missing
            if tag == "title":
                continue
        elif hidden == "head":
            if tag in HEAD_TAGS and not (ends and tag == "head"):
                if tag == "title" and not ends:
                    hidden = "title"
                continue
            hidden = ""
        elif hidden in ("svg", "template"):
            if tag == hidden and not closed:
                depth += -1 if ends else 1
            if depth and not (hidden == "svg" and tag in BLOCK_TAGS):
                continue
            hidden, depth = "", 0
            if tag in ("svg", "template"):
                continue
        if tag == "head":
            hidden = "" if ends else "head"
        elif tag == "title":
            hidden = "" if ends else "title"
        elif tag == "svg":
            if not ends and not closed:
                hidden, depth = tag, 1
        elif tag == "template" and not ends and _TEMPLATE_END.search(page, m.end()):
            hidden, depth = tag, 1
        elif tag in BLOCK_TAGS:
            flush()
            if ends:
                for i in range(len(path) - 1, -1, -1):
                    if path[i][0] == tag:
                        del path[i:]
                        break
            elif not closed and tag != "hr":
                # A paragraph ends where another block begins; an item ends at the next.
                while path and (path[-1][0] == "p" or (path[-1][0] == tag and tag in ("li", "td", "tr", "dt", "dd", "option"))):
                    path.pop()
                path.append((tag, _name_words(m[4])))
        elif tag == "a":
            anchor = 0 if ends else 1
        elif tag in ("br", "img", "input", "wbr"):
            parts.append(" ")
    flush()
    return out


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


def path_vector(path: tuple) -> np.ndarray:
    """Hashed tags and names on the way to a block; the last tag stands for itself too."""
    out = np.zeros(PATH, np.float32)
    for tag, names in path:
        out[_slot("<" + tag, PATH)] = 1
        for w in names:
            out[_slot("." + w, PATH)] = 1
    if path:
        out[_slot("/" + path[-1][0], PATH)] = 1
    return out


def text_vector(block: Block, place: float) -> np.ndarray:
    """Shares of hashed words, and measures of a block."""
    words = block.text.split(" ")
    out = np.zeros(WORDS + _MEASURES, np.float32)
    slots = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words)) % WORDS
    out[:WORDS] = np.bincount(slots, minlength=WORDS) / len(words)
    n = len(block.text)
    out[WORDS:] = (np.log1p(n) / 5, np.log1p(len(words)) / 5, block.linked / n, block.text.count(".") / len(words), place, 1)
    return out


class Network:
    """One LSTM from each side and a logistic layer over both."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        size, h = PATH + WORDS + _MEASURES, HIDDEN

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": draw(size, 4 * h) * 2, f"h{d}": draw(h, 4 * h), f"c{d}": np.zeros(4 * h, np.float32)}
            self.p[f"c{d}"][h : 2 * h] = 1  # gates that keep begin open
        self.p |= {"o": draw(2 * h, 1), "k": np.zeros(1, np.float32)}

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (np.tanh(0.5 * x) + 1)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction; gates: (steps, pages, 4 h) from the input, mask: (steps, pages, 1)."""
        steps, pages, _ = gates.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.p["h" + d]
            s = self._sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((t, i, f, o, g, c, tanh, h))
            m = mask[t]
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, kept

    def predict(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        """Article probability of each block: (steps, pages)."""
        both = np.concatenate([self._run(gates[d], mask, d, False)[0] for d in "fb"], axis=2)
        return self._sigmoid(both @ self.p["o"] + self.p["k"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        runs = {d: self._run(x @ self.p["x" + d] + self.p["c" + d], mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        guess = self._sigmoid(both @ self.p["o"] + self.p["k"])
        error = (guess - y[..., None]) * mask / mask.sum()
        grads = {"o": np.einsum("tpi,tpj->ij", both, error), "k": error.sum((0, 1))}
        back = error @ self.p["o"].T
        for n, d in enumerate("fb"):
            upper, kept = back[..., n * HIDDEN : (n + 1) * HIDDEN], runs[d][1]
            dh, dc = np.zeros_like(upper[0]), np.zeros_like(upper[0])
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            grads["h" + d] = np.zeros_like(self.p["h" + d])
            for t, i, f, o, g, c, tanh, h in reversed(kept):
                m = mask[t]
                dh = dh + upper[t]
                live = dh * m
                dnew = dc * m + live * o * (1 - tanh * tanh)
                dz[t] = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - g * g)), axis=1)
                grads["h" + d] += h.T @ dz[t]
                dh, dc = dz[t] @ self.p["h" + d].T + dh * (1 - m), dnew * f + dc * (1 - m)
            grads["x" + d] = np.einsum("tpi,tpj->ij", x, dz)
            grads["c" + d] = dz.sum((0, 1))
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, at_once: int = 16) -> None:
        """Adam over batches of pages of (vectors, labels)."""
        order, rng = sorted(range(len(pages)), key=lambda i: len(pages[i][1])), random.Random(7)
        groups = [order[i : i + at_once] for i in range(0, len(order), at_once)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            rng.shuffle(groups)
            for group in groups:
                steps = max(len(pages[i][1]) for i in group)
                x = np.zeros((steps, len(group), PATH + WORDS + _MEASURES), np.float32)
                y, mask = np.zeros((steps, len(group)), np.float32), np.zeros((steps, len(group), 1), np.float32)
                for n, i in enumerate(group):
                    k = len(pages[i][1])
                    x[:k, n], y[:k, n], mask[:k, n] = *pages[i], 1
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def vectors(found: list[Block]) -> np.ndarray:
    """One row for each block of a page."""
    return np.stack([np.concatenate((path_vector(b.path), text_vector(b, i / len(found)))) for i, b in enumerate(found)])


class Layouts:
    """Makes pages whose article is known, from names and tags that sites use."""

    #: Names that mark each part of a page.
    PARTS = {
        "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "links"),
        "head": ("header", "masthead", "topbar", "site-header", "banner", "logo"),
        "foot": ("footer", "site-footer", "copyright", "bottom", "legal"),
        "side": ("sidebar", "aside", "widget", "related", "recommended", "trending", "tags"),
        "note": ("notice", "cookie", "alert", "consent", "message", "popup", "warning", "subscribe"),
        "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo"),
        "form": ("form", "search", "newsletter", "signup", "login", "contact"),
        "remark": ("comments", "comment", "reply", "discussion", "responses", "remarks"),
        "share": ("share", "social", "byline", "meta", "toolbar"),
    }
    MAIN = ("article", "content", "post", "entry", "main", "story", "body", "text", "page")
    TAGS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.rng
        made = ("".join(r.choice(("an", "er", "in", "the", "st", "ou", "ti", "que", "la", "ung", "ch", "ción", "es", "de", "en", "or")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most)))
        text = " ".join(w + ("." if r.random() < 0.1 else "") for w in made)
        return text[:1].upper() + text[1:] + r.choice((".", ".", ""))

    def named(self, part: str) -> str:
        r = self.rng
        name = r.choice(self.PARTS[part]) if part in self.PARTS else r.choice(self.MAIN)
        name = r.choice((name, name, f"{name}-{r.choice(('box', 'area', 'wrap', 'list', 'inner', 'item', 'block'))}", f"{r.choice(('site', 'page', 'main', 'top', 'js'))}-{name}" if part in self.PARTS else name))
        return f'{r.choice(("class", "class", "id"))}="{name}"'

    def part(self, part: str) -> list[tuple[str, bool]]:
        """Pieces of markup, each with whether its text is article text."""
        r = self.rng
        tag = self.TAGS.get(part, "section" if r.random() < 0.2 else "noscript" if part == "note" and r.random() < 0.3 else "div")
        bare = tag not in ("div", "section") and r.random() < 0.5
        tag = tag if bare or r.random() < 0.5 else "div"
        begin = f"<{tag}>" if bare else f"<{tag} {self.named(part)}>"
        out = [(begin, False)]
        for _ in range(r.randint(1, 4)):
            if part in ("menu", "head", "side", "share") and r.random() < 0.7:
                out.append(("<ul>" + "".join(f'<li><a href="/x">{self.words(1, 4)}</a></li>' for _ in range(r.randint(2, 7))) + "</ul>", False))
            elif part == "form":
                out.append((f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>", False))
            elif part == "remark":
                out.append((f'<div {self.named("remark")}><p>{self.words(3, 60)}</p></div>', False))
            else:
                inner = self.words(2, 40 if part in ("note", "advert", "side", "remark") else 12)
                out.append((r.choice((f"<p>{inner}</p>", inner, f"<h3>{inner}</h3><p>{self.words(2, 20)}</p>")), False))
                break
        return [*out, (f"</{tag}>", False)]

    def article(self) -> list[tuple[str, bool]]:
        r = self.rng
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        begin = f"<{tag}>" if tag in ("article", "main") and r.random() < 0.6 else f"<{tag} {self.named('')}>"
        out = [(begin, False)]
        if r.random() < 0.9:
            out.append((f"<h1>{self.words(2, 12)}</h1>", True))
        for _ in range(r.choice((1, 3, 6, 12, 25))):
            kind = r.random()
            if kind < 0.62:
                out.append((f"<p>{self.words(1, r.choice((3, 12, 60, 150)))}</p>", True))
            elif kind < 0.74:
                out.append((f"<p><b>{self.words(1, 9)}<br>", True))
            elif kind < 0.82:
                out.append((f"<h2>{self.words(1, 8)}</h2>", True))
            elif kind < 0.9:
                out.append(("<ul>" + "".join(f"<li>{self.words(1, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>", True))
            elif kind < 0.95:
                out.append((r.choice(("<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")).format(self.words(3, 40)), True))
            else:
                out += self.part(r.choice(("advert", "share", "note")))
        return [*out, (f"</{tag}>", False)]

    def page(self) -> tuple[list[Block], np.ndarray]:
        """Blocks of a page and which are article."""
        r = self.rng
        before = r.sample(("head", "menu", "note", "advert", "form", "side"), r.randint(0, 4))
        after = r.sample(("advert", "side", "remark", "form", "share", "note"), r.randint(0, 4)) + (["foot"] if r.random() < 0.85 else [])
        pieces = [p for part in before for p in self.part(part)] + self.article() + [p for part in after for p in self.part(part)]
        if r.random() < 0.4:
            pieces = [(f"<div class={r.choice(('page', 'wrapper', 'container'))}>", False), *pieces, ("</div>", False)]
        # The mark tells article text from the rest once blocks are cut.
        page = "<html><body>" + "".join(re.sub(r">([^<]+)", ">\x02\\1", p) if yes else p for p, yes in pieces)
        found = blocks(page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.1 else page + "</body></html>")
        labels = np.array(["\x02" in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace("\x02", "") or "."
        return found, labels


def _named_article(found: list[Block]) -> np.ndarray | None:
    """Labels of a page whose markup names the article itself, or None."""
    inside = np.array([any(t in ("article", "main") for t, _ in b.path) for b in found], np.float32)
    outside = np.array([any(t in ("nav", "aside", "footer", "header", "form") for t, _ in b.path) for b in found], bool)
    return np.where(outside, 0, inside).astype(np.float32) if inside.any() else None


def train(pages: DataFrame, generated: int = GENERATED, sampled: int = SAMPLED) -> Network:
    """A network from ``generated`` made pages and at most ``sampled`` of the table's pages (of fewer than ``LONGEST`` blocks) whose markup names the article."""
    makes = Layouts(11)
    known = [(vectors(f), y) for f, y in (makes.page() for _ in range(generated)) if f]
    ids = [r.page_id for r in pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sampled).collect()]
    for r in pages.where(F.col("page_id").isin(ids) & F.col("html").isNotNull()).select("page_id", "html").limit(2 * sampled).collect() if ids else ():
        found = blocks(r.html)
        if found and len(found) < LONGEST and (y := _named_article(found)) is not None:
            known.append((vectors(found), y))
    network = Network()
    network.fit(known)
    return network


class Labeller:
    """Texts of pages by a trained network; paths met before are not hashed again."""

    def __init__(self, network: Network) -> None:
        self.network, self.paths = network, {}

    def path_gates(self, path: tuple) -> np.ndarray:
        if (got := self.paths.get(path)) is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            v = path_vector(path)
            got = self.paths[path] = np.concatenate([v @ self.network.p["x" + d][:PATH] + self.network.p["c" + d] for d in "fb"])
        return got

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Article probabilities of the blocks of each page."""
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        lower = np.concatenate([self.network.p["x" + d][PATH:] for d in "fb"], axis=1)
        while order:
            # As many pages at once as keep the padded batch small.
            take = max(1, min(AT_ONCE, 200_000 // len(pages[order[min(len(order), AT_ONCE) - 1]])))
            group, order = order[:take], order[take:]
            steps = len(pages[group[-1]])
            gates = np.zeros((steps, len(group), 8 * HIDDEN), np.float32)
            mask = np.zeros((steps, len(group), 1), np.float32)
            for n, i in enumerate(group):
                k = len(pages[i])
                text = np.stack([text_vector(b, j / k) for j, b in enumerate(pages[i])])
                gates[:k, n] = text @ lower + np.stack([self.path_gates(b.path) for b in pages[i]])
                mask[:k, n] = 1
            guess = self.network.predict({"f": gates[..., : 4 * HIDDEN], "b": gates[..., 4 * HIDDEN :]}, mask)
            for n, i in enumerate(group):
                out[i] = guess[: len(pages[i]), n]
        return out

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main text of each page, blocks joined by line feeds."""
        found = [blocks(p) for p in pages]
        return ["\n".join(b.text for b, p in zip(f, y.tolist(), strict=True) if p > 0.5) for f, y in zip(found, self.label(found), strict=True)]


def extract(pages: DataFrame, network: Network) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(network)
        for batch in batches:
            for i in range(0, len(batch), 4 * AT_ONCE):
                part = batch.iloc[i : i + 4 * AT_ONCE]
                texts = labeller.texts(part["html"].tolist())
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    return map_pandas(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
