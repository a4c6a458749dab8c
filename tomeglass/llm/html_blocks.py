"""Main text of web pages: a bidirectional LSTM labels every text block from its tag path and words and its neighbours."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements inside a line, elements without an end, elements whose content is not markup or not shown.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math title textarea select canvas audio video".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta".split()) | RAW - {"iframe", "svg", "math", "textarea", "select", "canvas", "audio", "video", "object"}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"[\s\x00]+")

# Elements that have a place of their own in a block's vector; those of them that say what they hold; and the parts of
# classes, ids and roles that do. Other names say how an element looks, or nothing, and count for nothing.
TAGS = (
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
TELLING_TAGS = frozenset("article aside dialog footer form header main menu nav".split())
TELLING = (
    "article blog body content entry main post prose story"
    " breadcrumb menu nav navbar navigation pager pagination skip tab toolbar"
    " banner header hero logo masthead topbar"
    " colophon copyright footer imprint legal"
    " archive aside category popular recent recommended related side sidebar tag trending widget"
    " alert consent cookie gdpr modal newsletter notice overlay paywall popup subscribe"
    " ad ads advert advertisement advertising promo promoted promotion sponsor sponsored"
    " contact form login register search signup"
    " comment commentlist discussion disqus feedback reply replies respond response review thread"
    " author byline follow meta share social"
).split()

TAG_SLOT = {tag: i for i, tag in enumerate(TAGS)}
NAME_SLOT = {name: i for i, name in enumerate(TELLING)}
# A path's elements, its last one, all telling names on it, and the innermost telling element's tag and names.
LEAF, NAMES = len(TAGS) + 1, 2 * (len(TAGS) + 1)
NEAR_TAG, NEAR_NAME = NAMES + len(TELLING), NAMES + len(TELLING) + len(TAGS) + 1
PATH_WIDTH, WORD_WIDTH, PLAIN = NEAR_NAME + len(TELLING), 32, 10
WIDTH = PATH_WIDTH + WORD_WIDTH + PLAIN


class Block(NamedTuple):
    """Text of a leaf block, its elements from the root on, the names and classes of each, and how much of it is links."""

    text: str
    path: tuple[str, ...]
    names: tuple[tuple[str, ...], ...]
    linked: int


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: runs of text between the tags of elements that are not inside a line.

    Character references are decoded, white space (a line break too) is one space, and what is never shown is left out. End
    tags without a start are skipped, missing ones are made up for. A cut-off tag at the end is no text.
    """
    out: list[Block] = []
    path: list[str] = []
    names: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text and "head" not in path:
            out.append(Block(text, tuple(path), tuple(names), min(linked, len(text))))
        parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if "a" in path:
                linked += len(plain.strip())

    at = 0
    low = None
    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            rest = page[at:]
            cut = rest.rfind("<")
            text(rest if cut < 0 or not re.match(r"</?[a-zA-Z]", rest[cut:]) else rest[:cut])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in path:
                if tag not in INLINE:
                    flush()
                while path:
                    names.pop()
                    if path.pop() == tag:
                        break
            elif tag not in INLINE:
                flush()
            continue
        if "head" in path and tag not in IN_HEAD:
            # The end tag of head may be left out: what cannot stand in it ends it.
            flush()
            while path:
                names.pop()
                if path.pop() == "head":
                    break
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW and not attributes.endswith("/"):
            if low is None:
                low = page.lower()
            end = low.find(f"</{tag}", at)
            stop = page.find(">", end) if end >= 0 else -1
            at = len(page) if end < 0 else stop + 1 if stop >= 0 else len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSED_BY.get(tag, set())
            while path and (path[-1] == "p" or path[-1] in INLINE or path[-1] in ends):
                if path[-1] in INLINE and "p" not in path:
                    break
                path.pop()
                names.pop()
        if tag in VOID or attributes.endswith("/"):
            continue
        path.append(tag)
        own = [v for _, *values in NAMED.findall(attributes) for v in values if v]
        names.append(tuple(p.lower() for v in own for p in PART.findall(v)))
    flush()
    return out


@lru_cache(100_000)
def _name_slots(names: tuple[str, ...]) -> frozenset[int]:
    """Places of the telling names among ``names``; a plural counts as its singular."""
    slots = (NAME_SLOT.get(n, NAME_SLOT.get(n[:-1]) if n.endswith("s") else None) for n in names)
    return frozenset(s for s in slots if s is not None)


@lru_cache(100_000)
def _path_slots(path: tuple[str, ...], names: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    slots = {TAG_SLOT.get(tag, len(TAGS)) for tag in path}
    if path:
        slots.add(LEAF + TAG_SLOT.get(path[-1], len(TAGS)))
    near = False
    for tag, own in zip(reversed(path), reversed(names)):
        # What the page as a whole is called says nothing about its parts.
        told = _name_slots(own) if tag not in ("html", "body") else frozenset()
        slots.update(NAMES + i for i in told)
        if not near and (told or tag in TELLING_TAGS):
            near = True
            slots.update(NEAR_NAME + i for i in told)
            slots.add(NEAR_TAG + TAG_SLOT.get(tag, len(TAGS)))
    return tuple(slots)


def _word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_WIDTH


class Measured(NamedTuple):
    """The blocks of a page, and the share of its text before the end of each."""

    blocks: list[Block]
    before: np.ndarray


def measured(found: list[Block]) -> Measured:
    lengths = np.array([len(b.text) for b in found], np.float32)
    return Measured(found, np.cumsum(lengths) / max(float(lengths.sum()), 1.0))


def vectors(page: Measured, first: int = 0, last: int | None = None) -> np.ndarray:
    """One row per block from ``first`` to ``last``: elements and telling names of its path, hashed words, and plain measures."""
    some = page.blocks[first:last]
    rows = np.zeros((len(some), WIDTH), np.float32)
    for i, block in enumerate(some):
        row = rows[i]
        row[list(_path_slots(block.path, block.names))] = 1
        words = block.text.lower().split(" ")
        used = np.bincount([_word_slot(word) for word in words], minlength=WORD_WIDTH).astype(np.float32)
        row[PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = used / max(float(np.sqrt((used**2).sum())), 1.0)
        n, size = len(words), max(len(block.text), 1)
        row[-PLAIN:] = (
            np.log1p(n) / 4, block.linked / size, block.text[-1] in ".!?", sum(map(block.text.count, ",.;")) / n, any(c in block.text for c in "©|·»"),
            sum(map(str.isdigit, block.text)) / size, (first + i) / max(len(page.blocks) - 1, 1), float(page.before[first + i]), len(block.path) / 10, n < 4,
        )
    return rows


@dataclass(frozen=True)
class Settings:
    """Cells per direction, made-up pages to learn from, passes over them, pages per step, learning rate, and the seed."""

    cells: int = 16
    pages: int = 1800
    passes: int = 7
    batch: int = 48
    rate: float = 0.006
    seed: int = 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTM layers, one for each direction, and a logistic unit on both states of a block."""

    def __init__(self, how: Settings) -> None:
        rng = np.random.default_rng(how.seed)
        h = how.cells
        self.cells = h
        self.w: dict[str, np.ndarray] = {"o": rng.normal(0, 0.2, (2 * h, 1)), "ob": np.zeros(1)}
        for d in "fb":
            self.w[f"{d}x"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * h))
            self.w[f"{d}h"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.w[f"{d}b"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, begin: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = True) -> tuple[np.ndarray, list, tuple]:
        """States of one direction; x is (time, pages, width), rows beyond a page's end keep the state. Goes on from ``begin``, and keeps
        what learning needs."""
        h, time = self.cells, range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        state, memory = begin or (np.zeros((x.shape[1], h), np.float32),) * 2
        inputs = x @ self.w[f"{d}x"] + self.w[f"{d}b"]
        out, tape = np.zeros((*x.shape[:2], h), np.float32), []
        for t in time:
            gates = inputs[t] + state @ self.w[f"{d}h"]
            i, f, o, g = _sigmoid(gates[:, :h]), _sigmoid(gates[:, h : 2 * h]), _sigmoid(gates[:, 2 * h : 3 * h]), np.tanh(gates[:, 3 * h :])
            new = f * memory + i * g
            bent = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((t, i, f, o, g, memory, bent, state))
            memory = np.where(m, new, memory)
            state = np.where(m, o * bent, state)
            out[t] = state
        return out, tape, (state, memory)

    def _back(self, d: str, x: np.ndarray, mask: np.ndarray, tape: list, grad_out: np.ndarray, grads: dict) -> None:
        h = self.cells
        d_state = d_memory = np.zeros((x.shape[1], h), np.float32)
        d_inputs = np.zeros((*x.shape[:2], 4 * h), np.float32)
        d_h = np.zeros_like(self.w[f"{d}h"])
        for t, i, f, o, g, memory, bent, state in reversed(tape):
            m = mask[t][:, None]
            d_state = d_state + grad_out[t]
            ds = np.where(m, d_state, 0)
            dm = np.where(m, d_memory + ds * o * (1 - bent**2), 0)
            gates = np.concatenate([dm * g * i * (1 - i), dm * memory * f * (1 - f), ds * bent * o * (1 - o), dm * i * (1 - g**2)], axis=1)
            d_inputs[t] = gates
            d_h += state.T @ gates
            d_state = np.where(m, gates @ self.w[f"{d}h"].T, d_state)
            d_memory = np.where(m, dm * f, d_memory)
        grads[f"{d}h"] = d_h
        grads[f"{d}x"] = np.tensordot(x, d_inputs, ((0, 1), (0, 1)))
        grads[f"{d}b"] = d_inputs.sum(axis=(0, 1))

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask, keep=False)[0] for d in "fb"], axis=2)
        return _sigmoid((both @ self.w["o"])[..., 0] + self.w["ob"])

    def page_chances(self, pages: list[Measured], at_once: int) -> np.ndarray:
        """How likely each block is main text, as (time, pages); ``at_once`` blocks of the longest page are looked at together."""
        longest = max(len(p.blocks) for p in pages)
        score = np.full((longest, len(pages)), self.w["ob"][0])
        starts, last = range(0, longest, at_once), None
        for d, half in (("f", self.w["o"][: self.cells]), ("b", self.w["o"][self.cells :])):
            begin = None
            for first in starts if d == "f" else reversed(starts):
                if last is None or last[0] != first:
                    last = (first, *_padded([vectors(p, first, first + at_once) for p in pages]))
                out, _, begin = self._run(d, last[1], last[2], begin, keep=False)
                score[first : first + len(out)] += (out @ half)[..., 0]
        return _sigmoid(score)

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over all blocks."""
        runs = {d: self._run(d, x, mask) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        off = np.where(mask, _sigmoid((both @ self.w["o"])[..., 0] + self.w["ob"]) - y, 0) / mask.sum()
        grads = {"o": np.tensordot(both, off[..., None], ((0, 1), (0, 1))), "ob": np.array([off.sum()])}
        back = off[..., None] * self.w["o"][:, 0]
        for d, part in (("f", back[..., : self.cells]), ("b", back[..., self.cells :])):
            self._back(d, x, mask, runs[d][1], part, grads)
        return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(1, *map(len, pages))
    x, mask = np.zeros((longest, len(pages), WIDTH), np.float32), np.zeros((longest, len(pages)), bool)
    for i, rows in enumerate(pages):
        x[: len(rows), i], mask[: len(rows), i] = rows, True
    return x, mask


def labels(model: Labeller, pages: list[list[Block]], at_once: int = 20_000) -> list[np.ndarray]:
    """Whether each block belongs to the main text. Pages of like length go together, at most ``at_once`` padded rows; of a longer
    page so many rows are looked at together, with what came before and after handed on."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    while order:
        some = order[-max(1, at_once // len(pages[order[-1]])) :]
        del order[-len(some) :]
        chances = model.page_chances([measured(pages[i]) for i in some], at_once)
        for column, i in enumerate(some):
            out[i] = chances[: len(pages[i]), column] >= 0.5
    return out


# Made-up pages


SYLLABLES = "an at be da de el en er es ga ha in ia ka la le lo ma mi na ne no on or ra re ri sa se si ta te ti to un ver wo ze".split()
# Names that say how an element looks, not what it holds.
UTILITY = "flex grid row col container px py mx my text bg border rounded shadow md lg xl hidden block center gap items justify leading font bold gray white".split()
MAIN = [
    ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article body"), ("div", "entry content"), ("section", "story"), ("div", "post text"),
    ("td", "main"), ("div", ""), ("div", "text"), ("section", ""), ("td", ""),
]
# Surroundings of a main text: element, class or id, and words that are typical of it.
AROUND = {
    "menu": ([("nav", ""), ("div", "nav menu"), ("ul", "menu"), ("div", "navbar"), ("nav", "breadcrumb")], "home contact about news login search archive".split()),
    "head": ([("header", ""), ("div", "header banner"), ("div", "masthead")], "welcome subscribe home since".split()),
    "foot": ([("footer", ""), ("footer", ""), ("div", "footer"), ("div", "copyright legal")], "© · copyright rights reserved privacy terms imprint".split()),
    "side": ([("aside", ""), ("div", "sidebar"), ("aside", "related"), ("div", "widget recent"), ("div", "related posts"), ("section", "recommended")], "related popular recent more read also tags".split()),
    "notice": ([("div", "cookie notice"), ("div", "banner consent"), ("section", "notice alert"), ("div", "newsletter popup")], "cookies accept we use policy subscribe notice".split()),
    "advert": ([("div", "ad"), ("div", "ads sponsored"), ("aside", "advert promo"), ("div", "advertisement")], "buy now sponsored offer sale advertisement".split()),
    "form": ([("form", ""), ("form", "search"), ("form", "login comment")], "name email submit send password search".split()),
    "comments": ([("section", "comments"), ("div", "comments"), ("div", "comment list"), ("ol", "commentlist"), ("div", "disqus thread"), ("div", "replies"), ("section", "discussion"), ("div", "respond")], "says reply commented on great thanks".split()),
}


class Author:
    """Writes pages whose blocks have known labels."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.main: set[str] = set()
        self.oddness = 0.0
        self.utility = 0
        self.nested = 0.0

    def named(self, name: str) -> str:
        """A class list: on some pages its own names stand among many that say nothing."""
        if not self.utility or self.rng.random() < 0.3:
            return name
        some = [self.pick(UTILITY) for _ in range(int(self.rng.integers(1, self.utility)))]
        return " ".join([name, *some] if self.rng.random() < 0.5 else [*some, name]).strip()

    def wrapped(self, inner: str) -> str:
        """``inner``, on some pages inside nested elements without a meaning."""
        for _ in range(int(self.rng.integers(0, 4)) if self.utility else 0):
            inner = f'<div class="{self.named("")}">{inner}</div>'
        return inner

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, n: int, some: list[str] = []) -> list[str]:  # noqa: B006
        out = ["".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        return [self.pick(some) if some and self.rng.random() < 0.3 else w for w in out]

    def prose(self, low: int, high: int) -> str:
        sentences = []
        n = int(self.rng.integers(low, high))
        while n > 0:
            k = min(n, int(self.rng.integers(2, 18)))
            sentences.append(" ".join(self.words(k)).capitalize() + self.pick([".", ".", ".", "!", "?"]))
            n -= k
        text = " ".join(sentences)
        return self.odd(text) if self.rng.random() < self.oddness else text

    def odd(self, text: str) -> str:
        """Tables, shouting, signs, repeats, numbers: whatever a text looks like, its place decides."""
        words = text.split(" ")
        kind = int(self.rng.integers(6))
        if kind == 0:
            return " | ".join(words)
        if kind == 1:
            return " ".join(w.upper() + "!!" for w in words)
        if kind == 2:
            return " ".join(w + self.pick(["***", "###", "&&&", "$$$", "%%%"]) for w in words)
        if kind == 3:
            return " ".join(w for w in words[:8] for _ in range(int(self.rng.integers(2, 25))))
        if kind == 4:
            return " ".join(w if self.rng.random() < 0.6 else str(int(self.rng.integers(1, 10**9))) for w in words)
        return text.rstrip(".!?") + self.pick([" ©", " ·", " »", "", " name@mail.example"])

    def paragraph(self, text: str) -> str:
        plain, text = text, html.escape(text)
        if self.rng.random() < 0.35:
            first, _, rest = text.partition(" ")
            text = self.pick(["<b>{}</b> {}", "<em>{}</em> {}", '<a href="/x">{}</a> {}', "<b>{} {}"]).format(first, rest)
            text = text if self.rng.random() < 0.6 else f"<b>{html.escape(plain)}"
        return self.pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p>{}<br>", "<div>{}</div>"]).format(text)

    def body(self) -> str:
        tag, name = self.pick(MAIN)
        out = []
        if self.rng.random() < 0.8:
            out.append(f"<{self.pick(['h1', 'h1', 'h2'])}>{{}}</h1>".format(self.note(self.prose(2, 12).rstrip(".!?") if self.rng.random() < 0.5 else self.prose(3, 14))))
        for _ in range(int(self.rng.integers(0, 9))):
            kind = self.rng.random()
            if kind < 0.82:
                text = self.prose(1, 8) if self.rng.random() < 0.25 else self.prose(8, 90) if self.rng.random() < 0.97 else self.prose(200, 800)
                self.main.add(SPACE.sub(" ", text).strip())
                out.append(self.wrapped(self.paragraph(text)))
            elif kind < 0.9:
                out.append(f"<h2>{self.note(' '.join(self.words(int(self.rng.integers(1, 6)))))}</h2>")
            elif kind < 0.95:
                out.append("<ul>" + "".join(f"<li>{self.note(self.prose(2, 12))}</li>" for _ in range(3)) + "</ul>")
            else:
                out.append(f"<blockquote>{self.note(self.prose(5, 30))}</blockquote>")
            if self.rng.random() < 0.12:
                out.append(self.around("advert"))
            if self.rng.random() < self.nested:
                out.append(self.around(self.pick(["side", "side", "form", "notice", "comments", "foot", "menu", "advert"])))
        if not self.main:
            out.append(f"<p>{self.note(self.prose(2, 40))}</p>")
        return f'<{tag} class="{self.named(name)}">' + self.wrapped("".join(out)) + f"</{tag}>"

    def note(self, text: str) -> str:
        self.main.add(SPACE.sub(" ", text).strip())
        return html.escape(text)

    def around(self, kind: str) -> str:
        shells, words = AROUND[kind]
        tag, name = self.pick(shells)
        plain = lambda low, high: html.escape(" ".join(self.words(int(self.rng.integers(low, high)), words)))
        if kind == "menu" or kind == "side" and self.rng.random() < 0.5:
            items = "".join(f'<li><a href="/{i}">{plain(1, 3)}</a></li>' for i in range(int(self.rng.integers(2, 8))))
            inner = f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>{plain(1, 4)}</label><input name=q><button>{plain(1, 3)}</button><p>{plain(2, 12)}</p>"
        elif kind == "comments":
            inner = self.pick([f"<h3>{plain(1, 4)}</h3>", ""]) + "".join(f'<div class="{self.named(self.pick(["comment", "comment", "reply", "response", "", "post", "content body"]))}">{self.pick([f"<span>{plain(1, 3)}</span>", ""])}{self.wrapped(f"<p>{self.prose(3, 40) if self.rng.random() < 0.95 else self.prose(100, 400)}</p>")}</div>' for _ in range(int(self.rng.integers(1, 5))))
        elif self.rng.random() < 0.6:
            inner = self.pick(["{}", "<p>{}</p>", "<span>{}</span>", "&copy; {}", "&copy; name.example &middot; {}"]).format(html.escape(self.prose(2, 25)))
        else:
            inner = self.pick(["{}", "<p>{}</p>", "<h3>{}</h3>"]).format(plain(2, 20))
        name, inner = self.named(name), self.wrapped(inner)
        return f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def page(self) -> tuple[list[Block], np.ndarray]:
        self.main = set()
        self.oddness = self.pick([0.0, 0.1, 0.5, 0.9])
        self.utility = self.pick([0, 0, 8, 30])
        self.nested = self.pick([0.0, 0.0, 0.15, 0.4])
        body = self.body()
        before = "".join(self.around(k) for k in ("notice", "head", "menu", "advert", "side", "form") if self.rng.random() < 0.45)
        after = "".join(self.around(k) for k in ("comments", "side", "advert", "form", "notice", "foot") if self.rng.random() < 0.45)
        shell = self.pick(["{}{}{}", "{}{}{}", '<div class="wrapper">{}{}{}</div>', "<table><tr><td>{}</td><td>{}</td><td>{}</td></tr></table>", '<div id="page">{}{}</div>{}'])
        inner = shell.format(before, body, after)
        if self.rng.random() < 0.3:
            names = ["content", "main", "page", "post", "blog", "container", "with", "has", *(self.pick(TELLING) for _ in range(2))]
            inner = f'<div class="{" ".join(self.pick(names) for _ in range(int(self.rng.integers(1, 5))))}">{inner}</div>'
        found = blocks(f"<html><head><title>t</title></head><body>{inner}</body></html>")
        return found, np.array([b.text in self.main for b in found], np.float32)


@cache
def train(how: Settings = Settings()) -> Labeller:
    """A labeller that has learnt from ``how.pages`` made-up pages; the same settings give the same weights."""
    author, model = Author(how.seed), Labeller(how)
    made = [author.page() for _ in range(how.pages)]
    made = [(vectors(measured(found)), y) for found, y in made if found]
    rng = np.random.default_rng(how.seed)
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    steps = 0
    for turn in range(how.passes):
        order = rng.permutation(len(made))
        for first in range(0, len(order), how.batch):
            some = [made[i] for i in order[first : first + how.batch]]
            x, mask = _padded([rows for rows, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, own) in enumerate(some):
                y[: len(own), i] = own
            steps += 1
            rate = how.rate * (0.3 if turn >= how.passes - 2 else 1)
            for k, g in model.step(x, mask, y).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g**2
                model.w[k] = model.w[k] - rate * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.99**steps)) + 1e-8)
    return model


def main_text(pages: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(page_id, url, text, blocks) for every row of ``pages`` (page_id, url, html).

    ``text`` joins the blocks of the main text in page order by a newline; it is empty if there is none or the page is missing.
    ``blocks`` holds (text, path, main) of every block. The labeller learns from made-up pages of a fixed number, never from
    ``pages``, and every page is labelled as a whole, however long. Ids and URLs are handed through, missing or not. Other
    columns are ignored. Nothing is shuffled.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(how))
    kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("main", pa.bool_())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [blocks(p.as_py() or "") for p in part.column("html")]
                main = labels(model.value, found)
                texts = ["\n".join(b.text for b, m in zip(f, ms) if m) for f, ms in zip(found, main)]
                rows = [[{"text": b.text, "path": "/".join(b.path), "main": bool(m)} for b, m in zip(f, ms)] for f, ms in zip(found, main)]
                yield pa.record_batch(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array(rows, kind)],
                    ["page_id", "url", "text", "blocks"],
                )

    schema = "page_id bigint, url string, text string, blocks array<struct<text:string,path:string,main:boolean>>"
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(label, schema)
