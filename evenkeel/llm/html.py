"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between tags that are not inline. Each block
has the tags and the class, id and role words of all open elements, each once, of which those
met in training are read (some are left out there at random, so that a block may lack any), the
hashes of all its words and a few numbers. A bidirectional LSTM in numpy reads the blocks of a
page in order, so that every block is judged with the whole page in view, and labels it main
text or not.

The model is trained once per run in one task, on a bounded sample: `SAMPLE_PAGES` pages in
hash order lend their text blocks, which are set into page layouts drawn by rule (articles
with headings, lists, tables and quotes; menus, headers, footers, sidebars, notices,
adverts, forms, comments, related links, some with words of their kind), so that the right label
of every block is known.
Scoring works on each page alone.

Scripts, styles, templates, text areas, titles, embedded frames and comments are markup and are no
blocks, nor is what the attributes hidden, aria-hidden or style hide; all else is read. White
space inside a block becomes one space; blocks are joined by one line feed. Null and empty
html give an empty text; repeated rows and page_ids are treated alike; empty tables give no
rows (the model is then trained on the layouts alone). Other columns are not used.
"""

from __future__ import annotations

import html as entities
import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

SAMPLE_PAGES = 200  # pages that lend their text to the training layouts
PATHS, WORDS = 2048, 1024  # buckets of path words and of text words
WIDTH_PATH, WIDTH_WORD, HIDDEN, NUMBERS = 16, 6, 16, 5
POOL, EPOCHS, PER_STEP, RATE = 3000, 7, 32, 0.015  # drawn pages, passes over them, pages in a step, step size

INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q s samp small span "
    "strike strong sub sup svg time tt u var wbr "
    "math annotation mfrac mi mn mo mover mrow msqrt mstyle msub msubsup msup mtext munder semantics").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title noembed noframes".split())  # read up to their end tag
SHOWN_IN_PATH = frozenset("a svg".split())  # inline elements that count
CLOSES_P = frozenset((
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul").split())
ENDS_DRAWING = frozenset("b big br center code em embed i img nobr ruby s small span strong strike sub sup tt u var body".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = frozenset("class id role itemprop aria-label".split())
UNDISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: text, words of the path, and characters inside links."""
    if not page:
        return []
    found: list[Block] = []
    stack: list[tuple[str, list[str]]] = []  # open elements with the path words that they brought
    places: dict[str, list[int]] = {}  # of the open elements of a name in the stack
    path: dict[str, None] = {}  # words of all open elements, each once
    runs: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                found.append(Block(text, tuple(path), linked))
            runs.clear()
            linked = 0

    def pop(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        last = max((places[x][-1] for x in names if places.get(x)), default=-1)
        if last < 0 or any(places[x][-1] > last for x in stop if places.get(x)):
            return
        for name, words in reversed(stack[last:]):
            places[name].pop()
            for w in words:
                del path[w]
        del stack[last:]

    def keep(text: str) -> None:
        nonlocal linked
        if "#unseen" not in path:
            text = entities.unescape(text)
            runs.append(text)
            if "a" in path:
                linked += len(text)

    at, size, low = 0, len(page), None
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            keep(page[at:])
            break
        if m.start() > at:
            keep(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        drawn = bool(places.get("svg") or places.get("math"))
        inline = name in INLINE or drawn and not (name in CLOSES_P or name in SIBLINGS or name in ("text", "foreignobject", "body", "html"))
        if m.group(1):
            if not inline:
                end()
            if name != "br":
                pop((name,))
            continue
        rest = m.group(3) or ""
        if name in RAW:
            if not inline:
                end()
            low = page.lower() if low is None else low
            if len(low) != size:  # lower case may change the length of a text
                stop = re.compile(f"</{name}", re.I).search(page, at)
                close = stop.start() if stop else -1
            else:
                close = low.find(f"</{name}", at)
            after = page.find(">", close) if close >= 0 else -1
            at = size if close < 0 or after < 0 else after + 1
            continue
        if drawn and (name in CLOSES_P or name in SIBLINGS or name in ENDS_DRAWING):
            pop(("svg", "math"))
            drawn, inline = False, name in INLINE
        if name == "br":
            runs.append(" ")
            continue
        if not inline:
            end()
            if name in CLOSES_P:
                pop(("p",), ("table", "td", "th", "li", "div", "section", "article", "body"))
            if name in SIBLINGS:
                pop(SIBLINGS[name], ("ul", "ol", "dl", "table", "menu"))
        if name in VOID or drawn and rest.endswith("/"):
            continue
        words = []
        if not inline or name in SHOWN_IN_PATH:
            words.append(name)
        for key, *values in ATTRIBUTE.findall(rest) if rest else ():
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNDISPLAYED.search(value):
                words.append("#unseen")
            elif key in NAMING:
                words += [f"{'.' if key != 'itemprop' else '@'}{w.lower()}" for w in NAME.findall(value)]
        own = [w for w in dict.fromkeys(words) if w not in path]
        path.update(dict.fromkeys(own))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, own))
    end()
    return found


class Features:
    """Flat hashed features of a list of pages, each a list of blocks; `known` has the path words that are read (None: all)."""

    def __init__(self, pages: list[list[Block]], known: frozenset[str] | None = None):
        paths, path_of, words, word_of, numbers = [], [], [], [], []
        n = 0
        for page in pages:
            total = max(1, len(page))
            for k, b in enumerate(page):
                seen = [w for w in b.path if known is None or w in known]
                paths += [bucket(w, PATHS) for w in seen]
                path_of += [n] * len(seen)
                parts = b.text.split()
                words += [bucket(w.lower(), WORDS) for w in parts]
                word_of += [n] * len(parts)
                size = len(b.text)
                numbers.append((np.log1p(size) / 6, min(1.0, b.linked / size), k / total, np.log1p(total) / 5, b.text[-1] in ".!?:\"'…"))
                n += 1
        self.n = n
        self.path, self.path_of = np.array(paths, np.int64), np.array(path_of, np.int64)
        self.word, self.word_of = np.array(words, np.int64), np.array(word_of, np.int64)
        self.numbers = np.array(numbers, np.float32).reshape(n, NUMBERS)


    @classmethod
    def join(cls, parts: list[Features]) -> Features:
        whole, n = cls([]), np.cumsum([0, *[f.n for f in parts]])
        whole.n = int(n[-1])
        for name in ("path", "word", "numbers"):
            setattr(whole, name, np.concatenate([getattr(f, name) for f in parts]))
        for name in ("path_of", "word_of"):
            setattr(whole, name, np.concatenate([getattr(f, name) + k for f, k in zip(parts, n, strict=False)]))
        return whole


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, one LSTM each way, and a logistic output per block."""

    NAMES = ("path", "word", "wx0", "wh0", "b0", "wx1", "wh1", "b1", "out", "bias")

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7, known: frozenset[str] | None = None):
        self.known = known
        if weights is None:
            r = np.random.default_rng(seed)
            wide = WIDTH_PATH + WIDTH_WORD + NUMBERS
            weights = {"path": r.normal(0, 0.3, (PATHS, WIDTH_PATH)), "word": r.normal(0, 0.1, (WORDS, WIDTH_WORD))}
            for d in "01":
                weights["wx" + d] = r.normal(0, wide**-0.5, (wide, 4 * HIDDEN))
                weights["wh" + d] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
                weights["b" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
            weights |= {"out": r.normal(0, 0.2, (2 * HIDDEN + wide, 1)), "bias": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def pack(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, known=np.array(sorted(self.known or ()), "U"), **self.w)
        return held.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Labeller:
        with np.load(io.BytesIO(raw)) as z:
            return cls({k: z[k] for k in cls.NAMES}, known=frozenset(z["known"].tolist()))

    def inputs(self, f: Features) -> np.ndarray:
        x = np.zeros((f.n, WIDTH_PATH + WIDTH_WORD + NUMBERS), np.float32)
        np.add.at(x[:, :WIDTH_PATH], f.path_of, self.w["path"][f.path])
        if len(f.word):
            share = 1 / np.maximum(1, np.bincount(f.word_of, minlength=f.n))[:, None]
            bag = np.zeros((f.n, WIDTH_WORD), np.float32)
            np.add.at(bag, f.word_of, self.w["word"][f.word])
            x[:, WIDTH_PATH : WIDTH_PATH + WIDTH_WORD] = bag * share
        x[:, WIDTH_PATH + WIDTH_WORD :] = f.numbers
        return x

    def one_way(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: time, page, feature. Padding leaves the state as it is."""
        w, n = self.w, HIDDEN
        h = np.zeros((x.shape[1], n), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], n), np.float32)
        pre = x @ w["wx" + d] + w["b" + d]
        for t in range(len(x)) if d == "0" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ w["wh" + d]
            s = sigmoid(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[t] = h
        return out

    def forward(self, flat: np.ndarray, lengths: list[int], keep: dict | None = None) -> np.ndarray:
        """Logits of all blocks, page after page."""
        pages, longest = len(lengths), max(lengths)
        ends = np.cumsum(lengths)
        page = np.repeat(np.arange(pages), lengths)
        time = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        x = np.zeros((longest, pages, flat.shape[1]), np.float32)
        mask = np.zeros((longest, pages), bool)
        x[time, page], mask[time, page] = flat, True
        k0, k1 = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self.one_way(x, mask, "0", k0), self.one_way(x, mask, "1", k1)], 2)[time, page]
        top = np.concatenate([both, flat], 1)
        if keep is not None:
            keep |= {"x": x, "mask": mask, "k0": k0, "k1": k1, "time": time, "page": page, "top": top}
        return (top @ self.w["out"] + self.w["bias"])[:, 0]

    def score(self, pages: list[list[Block]], per_batch: int = 64) -> list[np.ndarray]:
        """Probability of main text for each block; pages of similar length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        for at in range(0, len(order), per_batch):
            part = order[at : at + per_batch]
            lengths = [len(pages[k]) for k in part]
            p = sigmoid(self.forward(self.inputs(Features([pages[k] for k in part], self.known)), lengths))
            for k, got in zip(part, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                out[k] = got
        return out

    def gradients(self, f: Features, lengths: list[int], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, n, keep = self.w, HIDDEN, {}
        flat = self.inputs(f)
        z = self.forward(flat, lengths, keep)
        p = sigmoid(z)
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        dz = ((p - y) / len(y)).astype(np.float32)[:, None]
        g = {"out": keep["top"].T @ dz, "bias": dz.sum(0)}
        dtop = dz @ w["out"].T
        dflat = dtop[:, 2 * n :].copy()
        time, page, x = keep["time"], keep["page"], keep["x"]
        dx = np.zeros_like(x)
        for d, half in (("0", dtop[:, :n]), ("1", dtop[:, n : 2 * n])):
            dout = np.zeros((*x.shape[:2], n), np.float32)
            dout[time, page] = half
            dh = np.zeros(dout.shape[1:], np.float32)
            dc = np.zeros_like(dh)
            gx, gh, gb = np.zeros_like(w["wx" + d]), np.zeros_like(w["wh" + d]), np.zeros_like(w["b" + d])
            for t, i, fg, o, gg, c, tc, h, m in reversed(keep["k" + d]):
                total = dh + dout[t]
                ch = np.where(m, total, 0)
                cc = np.where(m, dc, 0) + ch * o * (1 - tc * tc)
                dpre = np.concatenate([cc * gg * i * (1 - i), cc * c * fg * (1 - fg), ch * tc * o * (1 - o), cc * i * (1 - gg * gg)], 1)
                gx += x[t].T @ dpre
                gh += h.T @ dpre
                gb += dpre.sum(0)
                dx[t] += dpre @ w["wx" + d].T
                dh = dpre @ w["wh" + d].T + np.where(m, 0, total)
                dc = cc * fg + np.where(m, 0, dc)
            g |= {"wx" + d: gx, "wh" + d: gh, "b" + d: gb}
        dflat += dx[time, page]
        g["path"], g["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
        np.add.at(g["path"], f.path, dflat[f.path_of, :WIDTH_PATH])
        if len(f.word):
            share = (1 / np.maximum(1, np.bincount(f.word_of, minlength=f.n)))[f.word_of][:, None].astype(np.float32)
            np.add.at(g["word"], f.word, dflat[f.word_of, WIDTH_PATH : WIDTH_PATH + WIDTH_WORD] * share)
        return loss, g


# Words that name the parts of a page around the main text, and tags that do so.
AROUND = {
    "menu": ("nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager toc skip", ("nav", "div", "ul", "menu", "section")),
    "header": ("header masthead topbar site branding logo banner head tagline", ("header", "div")),
    "footer": ("footer foot bottom copyright legal colophon imprint credits", ("footer", "div")),
    "sidebar": ("sidebar aside side rail widget widgets complementary left right column secondary panel", ("aside", "div", "section")),
    "notice": ("notice cookie consent alert popup modal overlay gdpr banner message toast disclaimer warning privacy bar info paywall", ("div", "section", "aside", "p")),
    "advert": ("ad ads advert adverts advertisement sponsor sponsored promo promotion adsense banner adbox commercial adslot partner", ("div", "aside", "section", "ins", "p")),
    "form": ("form search newsletter subscribe signup login contact subscription", ("form", "div", "section")),
    "comments": ("comments comment replies reply discussion disqus respond reader reviews thread responses feedback", ("section", "div", "ol", "ul", "article", "aside")),
    "related": ("related recommended more share social sharing tags popular trending links readmore next prev also", ("div", "section", "aside", "ul")),
}
MAIN_WORDS = "article content post entry main story body text page blog single hentry news articlebody".split()
SMALL_WORDS = "x7 inner wrap wrapper container row col box clearfix block item list group unit grid flex js".split()

# Words that such parts are made of.
SAID = {
    "menu": "home about contact news products services blog archive sections login account more",
    "header": "welcome official site subscribe search today edition",
    "footer": "copyright rights reserved terms privacy imprint contact careers sitemap powered",
    "sidebar": "popular latest categories tags archives follow recent topics",
    "notice": "cookies cookie accept consent settings policy privacy agree browser update javascript continue",
    "advert": "buy sale off offer deal discount sponsored shop order free shipping price advertisement",
    "form": "email search submit subscribe newsletter password name sign send your enter",
    "comments": "reply said posted likes thanks agree wrote commented ago great comment",
    "related": "related read also share tweet recommended you might next previous print follow",
}
MIN_PATH = 3  # blocks of the drawn pages that a path word must have to be read
DROPPED = 0.03  # share of path words left out in training


class Layouts:
    """Page layouts drawn by rule, filled with given blocks of text, with the label of every block."""

    def __init__(self, texts: list[str], seed: int):
        self.texts = texts or ["the first one", "Another line of text.", "a third, and longer, line of text that ends."]
        self.r = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def long(self) -> str:
        text = self.pick(self.texts)
        return text if self.chance(0.8) else text[: int(self.r.integers(3, 80))].strip() or "x"

    def short(self) -> str:
        words = self.pick(self.texts).split()
        k = int(self.r.integers(max(1, len(words))))
        return " ".join(words[k : k + int(self.r.integers(1, 6))]) or "x"

    def said(self, kind: str, text: str) -> str:
        """The text, half of the time with some words of its kind among its first ones."""
        if self.chance(0.5):
            return text
        words, own = text.split(), SAID[kind].split()
        for _ in range(int(self.r.integers(1, 4))):
            words.insert(int(self.r.integers(0, min(len(words), 8) + 1)), self.pick(own))
        return " ".join(words)

    def control(self) -> str:
        """A form control or a drawing, which may stand anywhere and is never main text."""
        text = self.short()
        return self.pick([f"<button>{text}</button>", f"<select><option>{text}<option>{self.short()}</select>", f"<svg><text>{text}</text></svg>"])

    def heading(self, level: int, text: str) -> str:
        return f"<h{level}>{text}</h{level}>"

    def attributes(self, words: list[str], p: float) -> str:
        if not self.chance(p):
            return ""
        name = words[0] if self.chance(0.3) else self.pick(words)
        if self.chance(0.5):
            name = f"{name}{self.pick(['-', '_', ' '])}{self.pick(SMALL_WORDS + words)}"
        elif self.chance(0.2):
            name = f"{self.pick(SMALL_WORDS)}{self.pick(['-', '_', ' '])}{name}"
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def around(self, kind: str) -> str:
        words, tags = AROUND[kind]
        tag = self.pick(tags)
        own = {"menu": ("nav", "menu"), "header": ("header",), "footer": ("footer",), "sidebar": ("aside",), "form": ("form",)}.get(kind, ())
        out = f"<{tag}{self.attributes(words.split(), 0.45 if tag in own else 1.0)}>"
        listed = kind in ("menu", "related") and self.chance(0.8) or self.chance(0.25)
        if self.chance(0.5 if kind == "header" else 0.3):
            out += self.heading(int(self.r.integers(1 if kind == "header" else 2, 5)), self.short())
        n = int(self.r.integers(1, 9))
        if listed:
            out += "<ul>" + "".join(f'<li><a href="/x">{self.said(kind, self.short())}</a></li>' for _ in range(n)) + "</ul>"
        elif kind == "comments":
            for _ in range(n):
                inner = f"<p>{self.said(kind, self.long())}</p>"
                if self.chance(0.5):
                    own = self.pick(["div", "li", "article"])
                    inner = f"<{own}{self.attributes(words.split(), 0.6)}><b>{self.short()}</b>{inner}</{own}>"
                out += inner
        else:
            for _ in range(int(self.r.integers(1, 4))):
                text = self.said(kind, self.long() if self.chance(0.5) else self.short())
                out += self.pick([text, f"<p>{text}</p>", f"<div>{text}</div>", f'<p>{text} <a href="/y">{self.short()}</a></p>', f"<span>{text}</span>"])
        if kind == "form":
            out += f"<label>{self.said(kind, self.short())}</label><input name=q>{self.control()}"
        return out + f"</{tag}>"

    def body(self) -> str:
        """Blocks of the article; the mark \x02 in front of a text says that it is main text."""
        out = f"<h1>\x02{self.short()}</h1>" if self.chance(0.85) else ""
        for _ in range(int(self.r.integers(1, 14))):
            text = "\x02" + (self.long() if self.chance(0.85) else self.short())
            k = self.r.random()
            if k < 0.72:
                out += self.pick([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br><p>\x02{self.long()}</p>", f"<div>{text}</div>", f'<p>{text} <a href="/z">{self.short()}</a> {self.short()}</p>'])
            elif k < 0.80:
                out += self.heading(int(self.r.integers(2, 5)), "\x02" + self.short())
            elif k < 0.88:
                out += "<ul>" + "".join(f"<li>\x02{self.short()}</li>" for _ in range(int(self.r.integers(1, 5)))) + "</ul>"
            elif k < 0.94:
                out += f"<blockquote>{text}</blockquote>"
            else:
                out += f"<table><tr><td>\x02{self.short()}</td><td>\x02{self.short()}</td></tr></table>"
            if self.chance(0.05):
                out += self.control()
            if self.chance(0.15):
                out += self.around(self.pick(["advert", "related", "notice", "form", "form", "sidebar"]))
        if self.chance(0.08):
            out = f"<header>{out.replace('</h1>', '</h1></header>', 1)}" if "</h1>" in out else out
        return out

    def page(self) -> tuple[list[Block], np.ndarray]:
        before = [k for k in ("header", "menu", "notice", "advert", "sidebar", "form", "menu") if self.chance(0.5 if k == "header" else 0.35)]
        after = [k for k in ("comments", "related", "sidebar", "form", "advert", "notice", "footer", "footer") if self.chance(0.35)]
        tag = self.pick(["article", "article", "main", "div", "section"])
        opening = f"<{tag}{self.attributes(MAIN_WORDS, 0.4 if tag in ('article', 'main') else 0.8)}>"
        inside = self.around("comments") if self.chance(0.1) else ""
        main = f"{opening}{self.body()}{inside}</{tag}>"
        if self.chance(0.3):
            outer = self.pick(["main", "div", "section"])
            main = f"<{outer}{self.attributes(MAIN_WORDS + SMALL_WORDS, 0.7)}>{main}</{outer}>"
        middle = "".join(map(self.around, before)) + main + "".join(map(self.around, after))
        if self.chance(0.3):
            middle = f"<div{self.attributes(SMALL_WORDS, 0.7)}>{middle}</div>"
        page = f"<html><head><title>{self.short()}</title></head><body>{middle}</body></html>"
        if self.chance(0.15):
            page = page[: int(len(page) * (0.5 + self.r.random() / 2))]
        found = blocks(page)
        labels = np.array(["\x02" in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace("\x02", "").strip() or "x"
        return found, labels


def train(texts: list[str], seed: int = 7, pool: int = POOL, epochs: int = EPOCHS) -> Labeller:
    """Adam over a pool of drawn pages; the seed fixes the result."""
    model, draw = Labeller(seed=seed), Layouts(texts, seed)
    pages = [x for x in (draw.page() for _ in range(pool)) if x[0]]
    seen = Counter(w for b, _ in pages for x in b for w in x.path)
    model.known = frozenset(w for w, n in seen.items() if n >= MIN_PATH)
    for b, _ in pages:
        for x in b:
            x.path = tuple(w for w in x.path if not draw.chance(DROPPED))
    held = [(Features([b], model.known), len(b), y) for b, y in pages]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    batches = [order[at : at + PER_STEP] for _ in range(epochs) for order in [draw.r.permutation(len(held))] for at in range(0, len(held), PER_STEP)]
    for step, batch in enumerate(batches, 1):
        parts, lengths, labels = zip(*[held[k] for k in batch], strict=True)
        _, grads = model.gradients(Features.join(list(parts)), list(lengths), np.concatenate(labels))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * (1 - step / (len(batches) + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.w[k] = (model.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> bytes:
    """Weights of a labeller trained in one task on a sample of at most `sample` pages, of 64 blocks each at most."""
    text = F.col(f"`{html}`")
    drawn = hash_sample(pages.where(text.isNotNull()).select(text.alias("html")), F.col("html"), sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for batch in batches:
            for page in batch.column(0).to_pylist():
                texts += [b.text[:2000] for b in blocks(page)[:64]]
        yield pa.RecordBatch.from_arrays([pa.array([train(texts).pack()], pa.binary())], ["weights"])

    spark = pages.sparkSession
    rows = drawn.coalesce(1).mapInArrow(learn, "weights binary").collect()  # one row of some 100 KB per task
    if not rows:
        rows = spark.createDataFrame([("",)], "html string").coalesce(1).mapInArrow(learn, "weights binary").collect()
    return bytes(rows[0]["weights"])


def main_text(pages: DataFrame, weights: bytes, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.unpack(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, p in zip(page, good, strict=True) if p > 0.5)
                         for page, good in zip(found, model.score(found), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`").cast("string"), F.col(f"`{html}`").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
