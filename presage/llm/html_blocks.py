"""Main text of web pages: a bidirectional LSTM in numpy labels the text blocks of a page.

A block is the text between block-level tags. It is described by its tag path
(tags and class words of open elements, hashed), its words (hashed) and a few
sizes; the network reads a page's blocks in order from both ends, so each label
knows the whole page. It learns from a bounded sample of the pages, labelled by
their article, main or content elements, and from the sample's texts laid out anew with other
tags, class names, notices, adverts, forms and comments.
"""

from __future__ import annotations

import html
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from copy import copy
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from presage.llm.common import by_bytes

PATH, WORDS, SIZES = 256, 32, 6
WIDTH = PATH + WORDS + SIZES
HIDDEN = 24
WINDOW, RUN, SHOWN, RELAID = 8192, 1024, 40, 450  # dense rows at a time, blocks of a training run, blocks of a re-laid page, such pages at least

# HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style title noscript template textarea select option button svg math iframe object head".split())
RAW = "script|style|title|textarea|noscript|template|iframe"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("html body div article section main aside nav header footer form ul ol dl table tbody thead blockquote td th li figure".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(?:>|$)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGIT = re.compile(r"\d")
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(4096)
def mark(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        self[word] = got = zlib.crc32(word.encode("utf-8", "replace")) % WORDS
        return got


WORD_BUCKETS, CACHED_WORDS = _Buckets(), 200_000


class Features:
    """Feature rows of a page's blocks, made dense for a slice only.

    Distinct tag paths are held once and words as one byte each, so a page takes
    a small multiple of its own size however many blocks it has.
    """

    def __init__(self, paths: list[bytes], path_of: array, words: array, counts: array, sizes: array) -> None:
        self.paths = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, PATH)
        self.path_of, self.words = np.array(path_of, np.int64), np.array(words, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        self.sizes = np.array(sizes, np.float32).reshape(-1, 4)

    def __len__(self) -> int:
        return len(self.path_of)

    def part(self, a: int, b: int) -> Features:
        """Rows a to b, still not dense."""
        out = copy(self)
        out.path_of, out.starts, out.sizes = self.path_of[a:b], self.starts[a:b + 1], self.sizes[a:b]
        return out

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(len(self))
        rows = np.ones((max(0, b - a), WIDTH), np.float32)
        if b > a:
            rows[:, :PATH] = self.paths[self.path_of[a:b]]
            n_words = np.diff(self.starts[a:b + 1])
            cells = np.repeat(np.arange(b - a) * WORDS, n_words) + self.words[self.starts[a]:self.starts[b]]
            count = np.bincount(cells, minlength=(b - a) * WORDS).reshape(-1, WORDS)
            rows[:, PATH:PATH + WORDS] = count / np.sqrt((count ** 2).sum(1, keepdims=True))
            n, linked, stop, digits = self.sizes[a:b].T
            rows[:, PATH + WORDS:-1] = np.stack([np.log1p(n) / 8, np.minimum(1, linked / n), stop, np.log1p(n_words) / 6, digits / n], 1)
        return rows


class Element(NamedTuple):
    """An open element: what holds it, its tag, and the words of its class, id and role."""

    parent: Element | None
    tag: str
    names: frozenset[str]


def blocks(page: str, holders: list | None = None) -> tuple[list[str], Features]:
    """Texts of a page's non-empty blocks in order, and their features; the innermost open element of each goes to ``holders``."""
    stack: list[tuple[str, list[int], Element]] = []
    opened: Counter[str] = Counter()
    path = np.zeros(PATH, np.int32)
    texts, seen = [], {}
    path_of, words, counts, sizes = array("q"), array("B"), array("q"), array("f")
    parts: list[str] = []
    state = {"linked": 0, "hidden": 0, "links": 0}

    def cut() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found = text.lower().split()
                words.extend(map(WORD_BUCKETS.__getitem__, found))
                counts.append(len(found))
                path_of.append(seen.setdefault(np.minimum(path, 2).astype(np.uint8).tobytes(), len(seen)))
                sizes.extend((len(text), state["linked"], text[-1] in ".!?…\"”", len(DIGIT.findall(text))))
                texts.append(text)
                if holders is not None:
                    holders.append(stack[-1][2] if stack else None)
        state["linked"] = 0

    def pop() -> None:
        tag, marks, _ = stack.pop()
        for m in marks:
            path[m] -= 1
        opened[tag] -= 1
        state["links"] -= tag == "a"
        state["hidden"] -= tag in HIDDEN_TEXT

    def say(piece: str) -> None:
        if piece and not state["hidden"]:
            parts.append(piece)
            if state["links"]:
                state["linked"] += len(piece)

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            cut()
        elif tag == "br":
            say(" ")
        if m[2]:
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                while len(stack) > k:
                    pop()
                break
            if stack[k][0] in HOLDERS:
                break
        names: list[str] = []
        if tag in INLINE:
            marks = [mark("in:" + tag)]
        else:
            if m[4]:
                names = [w.lower() for value in NAMED.findall(m[4]) for w in CLASS_WORD.findall("".join(value))]
            marks = [mark("tag:" + tag)] + [mark("name:" + w) for w in names]
        stack.append((tag, marks, Element(stack[-1][2] if stack else None, tag, frozenset(names)) if holders is not None else None))
        for k in marks:
            path[k] += 1
        opened[tag] += 1
        state["links"] += tag == "a"
        state["hidden"] += tag in HIDDEN_TEXT
    say(page[at:])
    cut()
    if len(WORD_BUCKETS) > CACHED_WORDS:
        WORD_BUCKETS.clear()
    return texts, Features(list(seen), path_of, words, counts, sizes)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.p["out"] = rng.normal(0, 0.2, (2 * HIDDEN,)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None, before: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states (pages x steps x HIDDEN) in one direction from those before, and the last; steps beyond a page's end keep the state.

        One numpy step per block, for all pages at once.
        """
        pages, steps, _ = x.shape
        drive = x @ self.p["x" + d] + self.p["c" + d]
        h, c = before or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((pages, steps, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = drive[:, t] + h @ self.p["h" + d]
            i, f, o = (sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = mask[:, t, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, on))
            h, c = on * (o * th) + (1 - on) * h, on * c2 + (1 - on) * c
            out[:, t] = h
        return out, (h, c)

    def probabilities(self, pages: list) -> list[np.ndarray]:
        """Per page, the chance of each block to be main text.

        Pages of like length go through together, in windows of WINDOW rows whose
        states pass from one to the next, so every label knows the whole page and
        only one window is dense.
        """
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            size = max(1, min(128, 200_000 // max(1, len(pages[order[min(at + 127, len(order) - 1)]]))))
            part = [pages[i] for i in order[at:at + size]]
            longest, step = len(part[-1]), max(1, WINDOW // len(part))
            total = np.zeros((len(part), longest), np.float32)
            for k, d in enumerate("fb"):
                state = None
                windows = range(0, longest, step)
                for a in windows if d == "f" else reversed(windows):
                    hidden, state = self.states(*padded(part, a, a + step), d, before=state)
                    total[:, a:a + step] += hidden @ self.p["out"][k * HIDDEN:(k + 1) * HIDDEN]
            y = sigmoid(total + self.p["bias"])
            for k, i in enumerate(order[at:at + size]):
                out[i] = y[k, :len(pages[i])]
            at += size
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, rate: float, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        turn = 0
        for _ in range(epochs):
            mixed = rng.permutation(len(pages))
            runs = [sorted(mixed[a:a + 256], key=lambda i: len(pages[i])) for a in range(0, len(mixed), 256)]  # like lengths go together
            for part in [run[a:a + 32] for run in runs for a in range(0, len(run), 32)]:
                turn += 1
                for k, g in self.slopes([pages[i] for i in part], [labels[i] for i in part]).items():
                    g = np.clip(g, -1, 1)
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)

    def slopes(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy, back through time."""
        x, mask = padded(pages)
        kept = {"f": [], "b": []}
        hidden = {d: self.states(x, mask, d, kept[d])[0] for d in "fb"}
        both = np.concatenate([hidden["f"], hidden["b"]], 2)
        y = sigmoid(both @ self.p["out"] + self.p["bias"])
        want = np.zeros_like(y)
        for k, row in enumerate(labels):
            want[k, :len(row)] = row
        dy = (y - want) * mask / max(1.0, mask.sum())
        slope = {"out": np.einsum("pt,pth->h", dy, both), "bias": np.array([dy.sum()], np.float32)}
        for k, d in enumerate("fb"):
            into = dy[:, :, None] * self.p["out"][k * HIDDEN:(k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc, dw = np.zeros_like(into[:, 0]), np.zeros_like(into[:, 0]), np.zeros_like(self.p["h" + d])
            for t, h0, c0, i, f, o, g, th, on in reversed(kept[d]):
                dh = dh + into[:, t]
                dn = dh * on
                dc_in = dc * on + dn * o * (1 - th * th)
                dz = np.concatenate([dc_in * g * i * (1 - i), dc_in * c0 * f * (1 - f), dn * th * o * (1 - o), dc_in * i * (1 - g * g)], 1)
                dz_all[:, t] = dz
                dw += h0.T @ dz
                dh, dc = dz @ self.p["h" + d].T + dh * (1 - on), dc_in * f + dc * (1 - on)
            slope["h" + d] = dw
            slope["x" + d] = np.einsum("ptf,ptz->fz", x, dz_all, optimize=True)
            slope["c" + d] = dz_all.sum((0, 1))
        return slope


def padded(pages: list, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows a to b of all pages, filled up to the longest, and which are real."""
    parts = [p[a:b] for p in pages]
    steps = max(len(p) for p in parts)
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for k, p in enumerate(parts):
        x[k, :len(p)], mask[k, :len(p)] = p, 1
    return x, mask


#: Class words of page parts in the layouts that the labeller is shown.
ASIDES = ("nav menu navbar breadcrumb header masthead topbar footer bottom sidebar side widget related recommended more promo ad ads advert advertisement banner sponsor sponsored "
          "cookie notice consent popup modal newsletter subscribe signup login search form share social tags comments comment reply discussion reviews copyright legal disclaimer pagination toolbar").split()
BODIES = "content main article post entry story body text page".split()


def shown_pages(main: list[list[str]], other: list[str], seed: int, copies: int) -> Iterator[tuple[str, str]]:
    """Pages laid out by chance from sample texts: (html, marked), where ``marked`` has \\x01 in front of each main block."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    name = lambda words: pick(["-", "_", " "]).join({pick(words) for _ in range(int(rng.integers(1, 3)))})
    short = lambda: " ".join(pick(other).split()[:int(rng.integers(1, 14))])
    paragraph = lambda: pick(pick(main))

    def aside() -> str:
        tag = pick(["nav", "header", "footer", "aside", "form", "div", "div", "div", "section", "ul"])
        named = f' {pick(["class", "class", "id"])}="{name(ASIDES)}"' if tag in ("div", "section", "ul") or rng.random() < 0.5 else ""
        kind = int(rng.integers(5))
        if kind == 0 or tag in ("nav", "ul"):
            inner = "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(int(rng.integers(2, 8))))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == 1:
            inner = f"<p>{short()}</p>" * int(rng.integers(1, 3))
        elif kind == 2:
            inner = short() + ("" if rng.random() < 0.5 else f' <a href="/y">{short()}</a>')
        elif kind == 3:
            inner = f'<label>{short()}</label><input name="q"><h3>{short()}</h3>'
        else:
            inner = "".join(f'<div class="{name(ASIDES)}"><b>{short()}</b><p>{paragraph()}</p></div>' for _ in range(int(rng.integers(1, 4))))
            tag, named = pick(["section", "div", "aside", "ol"]), f' class="{pick(["comments", "comment-list", "discussion", "reviews", "replies", "related", "sidebar", "notice"])}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    for _ in range(copies):
        for whole in main:
            first = int(rng.integers(max(1, len(whole) - SHOWN + 1)))
            texts, inner, k = whole[first:first + SHOWN], [], 0
            while k < len(texts):
                tag = pick(["h1", "h2"]) if k == 0 else pick(["p", "p", "p", "p", "p", "p", "div", "h2", "ul", "ol", "blockquote", "pre", "table", "dl"])
                rows = texts[k:k + (int(rng.integers(2, 6)) if tag in ("ul", "ol", "table", "dl") else 1)]
                k += len(rows)
                if tag in ("ul", "ol", "table", "dl") and rng.random() < 0.7:
                    rows = [" ".join(t.split()[:int(rng.integers(1, 12))]) for t in rows]
                item = {"ul": "<li>{}</li>", "ol": "<li>{}</li>", "table": "<tr><td>{}</td></tr>", "dl": "<dd>{}</dd>"}.get(tag, "{}")
                inner.append(f"<{tag}>{''.join(item.format(chr(1) + t) for t in rows)}</{tag}>")
                if rng.random() < 0.06:
                    inner.append(aside())
            hold = pick(["article", "main", "div", "div", "section"])
            named = f' class="{name(BODIES)}"' if hold in ("div", "section") or rng.random() < 0.4 else ""
            body = f"<{hold}{named}>{''.join(inner)}{aside() if rng.random() < 0.3 else ''}</{hold}>"
            for _ in range(int(rng.integers(0, 3))):
                body = f"<div{pick(['', ' class=wrapper', ' id=page', ' class=container'])}>{body}</div>"
            marked = f"<body>{''.join(aside() for _ in range(int(rng.integers(0, 4))))}{body}{''.join(aside() for _ in range(int(rng.integers(0, 4))))}</body>"
            yield marked.replace("\x01", ""), marked


#: Parts inside an article that are not its text; a header there may hold the title.
PART_TAGS = frozenset("nav aside form footer".split())
PART_NAMES = frozenset(ASIDES) - frozenset("header bottom side".split())
MAIN_BY = (
    lambda e: e.tag == "article",
    lambda e: e.tag == "main" or "main" in e.names,
    lambda e: bool(e.names & frozenset("content article post entry story".split())),
)
MARKED = r"(?i)<(article|main)\b|\b(class|id|role)\s*=\s*(\"[^\">]*|'[^'>]*|[^\s>\"']*)(main|content|article|post|entry|story)"


def is_part(e: Element) -> bool:
    return e.tag in PART_TAGS or bool(e.names & PART_NAMES)


def own_labels(page: str) -> tuple[list[str], Features, np.ndarray | None]:
    """Blocks of a page and which its own markup calls main text; None if it says nothing.

    Main is the article element with the most text, else the main element or role,
    else the element with a content class; without its comments, forms, notices,
    adverts and the like. Elements that stand in such parts come last.
    """
    holders: list[Element | None] = []
    texts, x = blocks(page, holders)
    for rule in MAIN_BY:
        size: Counter[int] = Counter()
        clear: dict[int, bool] = {}
        within: list[set[int]] = []
        for text, e in zip(texts, holders):
            passed: list[int] = []
            part = False
            while e is not None:
                part = part or is_part(e)
                if not part and rule(e):
                    passed.append(id(e))
                elif part and e.tag not in ("html", "body"):
                    for k in passed:
                        clear[k] = False
                e = e.parent
            size.update(dict.fromkeys(passed, len(text)))
            within.append(set(passed))
        if size:
            best = max(size, key=lambda k: (clear.get(k, True), size[k]))
            return texts, x, np.array([best in w for w in within], np.float32)
    return texts, x, None


def learn(pages: list[str], copies: int = 3, epochs: int = 10, rate: float = 0.01) -> Labeller | None:
    """Fit on sample pages: their own layout, labelled by their markup, and their texts laid out anew.

    Long pages teach in runs of RUN blocks. Where no page's markup says what is main
    text, only re-laid pages teach, with the sample's blocks of 20 words or more that
    are not links as main text. Without any such block there is no model (None).
    Each page is re-laid ``copies`` times, or more often if the sample is small.
    """
    rows, labels, main, other, long, short = [], [], [], [], [], []
    for page in pages:
        texts, x, y = own_labels(page.replace("\x01", " "))
        plain = [html.escape(t, quote=False) for t in texts]
        if y is None:
            for t, row in zip(plain, x.sizes):
                (long if len(t.split()) >= 20 and row[1] < row[0] / 2 else short).append(t)
            continue
        if not y.any():
            continue
        for a in range(0, len(x), RUN):
            rows.append(x.part(a, min(a + RUN, len(x))))
            labels.append(y[a:a + RUN])
        main.append([t for t, on in zip(plain, y) if on])
        other += [t for t, on in zip(plain, y) if not on]
    if not main:
        main, other = [long[a:a + 8] for a in range(0, len(long), 8)], short
    if not main:
        return None
    for plain, marked in shown_pages(main, other or ["menu"], 0, max(copies, -(-RELAID // len(main)))):
        x = blocks(plain)[1]
        y = np.array([t.startswith("\x01") for t in blocks(marked)[0]], np.float32)
        if len(x) and len(x) == len(y):
            rows.append(x)
            labels.append(y)
    model = Labeller()
    model.fit(rows, labels, epochs, rate)
    return model


def train(pages: DataFrame, sample: int = 150, sample_bytes: int = 4 << 20, id_col: str = "page_id", html_col: str = "html") -> Labeller | None:
    """Fit on at most ``sample`` distinct pages of together at most ``sample_bytes``, chosen by a hash.

    Pages whose markup may tell the main text are taken; any pages with text if there
    is none. No model (None) if the sample holds no text to learn from.
    """
    text = F.col(html_col).cast("string")
    every = pages.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), text.alias("html"), F.octet_length(text).alias("size")).filter(F.col("size").between(1, sample_bytes))
    for usable in (every.filter(F.col("html").rlike(MARKED)), every):
        picked, room = [], sample_bytes
        for r in usable.groupBy("key").agg(F.max("size").alias("size")).orderBy("key").limit(sample).collect():  # keys first: no task sends pages that are not taken
            if r["size"] <= room:
                picked.append(r["key"])
                room -= r["size"]
        if picked:
            taken = every.filter(F.col("key").isin(picked)).groupBy("key").agg(F.min("html").alias("html"))
            return learn([r["html"] for r in taken.orderBy("key").collect()])
    return None


def extract(pages: DataFrame, model: Labeller | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row: main blocks of the whole html in page order, one line each; empty if there is none.

    Character references are decoded, white space in a block becomes one space.
    Null html is empty. Broken or cut-off markup is read as far as it goes;
    an unfinished tag at the end is dropped. Rows repeat if the input does. Without
    a model (nothing to learn from) every text is empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few tens of thousands of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "html", 4 << 20):
            read = [blocks(t or "") for t in b.column("html").to_pylist()]
            chance = shared.value.probabilities([x for _, x in read]) if shared.value else [()] * len(read)
            texts = ["\n".join(t for t, p in zip(texts, y) if p > 0.5) for (texts, _), y in zip(read, chance)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
