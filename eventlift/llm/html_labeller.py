"""Main text of web pages by a recurrent block labeller (operator 6).

A page is a sequence of leaf blocks. Each becomes a vector of its hashed tag path, its hashed
words and a few proportions; a bidirectional LSTM in numpy reads the sequence both ways and
says for every block whether it belongs to the article.

It is trained on a bounded sample of the pages themselves. Blocks under unmistakable names
(an article, a menu, a footer) label themselves. Each page is also shown in changed forms,
with the article under other names or none and with notices, sidebars, forms and reader
comments put in, so that neither a single name nor a single place decides.
"""

from __future__ import annotations

import pickle
import random
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm.html_blocks import Block, blocks
from eventlift.llm.tasks import Batches, arrow_map, batch_of
from eventlift.llm.words import Words

#: Pages used for training at most, those of the lowest hash, and blocks of each.
SAMPLE = 120
SAMPLE_BLOCKS = 120
VARIANTS = 3
EPOCHS, BATCH, LEARNING = 6, 16, 0.01
PATHS, WORDS, EXTRAS = 512, 128, 6
PROJECTED, HIDDEN = 24, 20
#: Share of training blocks and pages that are shown without a path.
HIDDEN_PATHS = 0.1
#: Blocks labelled at a time.
LABELLED_AT_ONCE, PROJECTED_AT_ONCE = 20_000, 4_000

#: Names that say what a part of a page is.
MAIN_NAMES = "article main articlebody content entry post story".split()
OTHER_NAMES = (
    "nav header footer aside form ad ads advert advertisement banner breadcrumb comment comments "
    "cookie cookies consent dialog disqus login menu modal newsletter notice popup promo related "
    "reply respond search share sidebar social sponsored subscribe tags toolbar widget"
).split()
MAIN, OTHER, UNKNOWN = 1.0, 0.0, -1.0


def silver(block: Block) -> float:
    """What a block's own path says of it."""
    names = {n.lstrip("<") for n in block.path}
    if names & set(OTHER_NAMES) or "<title" in block.path or "<button" in block.path or "<select" in block.path:
        return OTHER
    return MAIN if names & set(MAIN_NAMES) else UNKNOWN


def _variant(page: list[Block], r: random.Random) -> tuple[list[Block], list[float]]:
    """A page with its parts renamed and others put in, and what each block is."""
    labelled = [(b, silver(b)) for b in page]
    words = [w for b in page for w in b.text.split()] or ["word"]
    home = ("<html", "<body")
    article = r.choice(
        [("<article",), ("<main",), ("<div", r.choice(MAIN_NAMES)), ("<div", r.choice(MAIN_NAMES), "body"), ("<div",), ("<main", "<article"), ("<section",)]
    )

    def some(low: int, high: int) -> str:
        at = r.randrange(len(words))
        return " ".join(words[at : at + r.randint(low, high)]) or "word"

    def part(*path: str, size: tuple[int, int] = (1, 12), linked: float = 0.0) -> tuple[Block, float]:
        text = some(*size)
        return Block(text, home + path, int(len(text) * linked)), OTHER

    def named() -> str:
        return r.choice(OTHER_NAMES)

    before, after, inside = [], [], []
    for _ in range(r.randint(0, 6)):
        before.append(part(*r.choice([("<nav", "<ul", "<li", "<a"), ("<div", "menu", "<a"), ("<header", "<a"), ("<ul", "<li", "<a")]), size=(1, 3), linked=1.0))
    if r.random() < 0.5:
        before.append(part("<header", "<h1" if r.random() < 0.3 else "<p"))
    for target in (before, after):
        for _ in range(r.randint(0, 3)):
            kind = named()
            target.append(part(*r.choice([("<div", kind), ("<aside",), ("<aside", "<p"), ("<div", kind, "<p"), ("<form", "<label"), ("<section", kind)]), size=(1, 40)))
    for _ in range(r.choice([0, 0, 2, 4])):
        after.append(part(*r.choice([("<div", "comments", "<div", "comment", "<p"), ("<section", "comments", "<p"), ("<ol", "comments", "<li", "comment")]), size=(3, 60)))
    if r.random() < 0.8:
        after.append(part(*r.choice([("<footer",), ("<footer", "<p"), ("<div", "footer")]), size=(2, 20)))
    if r.random() < 0.5:
        inside.append(part(*article, *r.choice([("<aside",), ("<div", named()), ("<form",)]), size=(1, 20)))
    rows: list[tuple[Block, float]] = list(before)
    for block, label in labelled:
        if label == MAIN:
            tail = block.path[-1] if block.path and block.path[-1].startswith("<") else "<p"
            tail = tail if tail not in ("<article", "<main", "<body") else "<p"
            rows.append((Block(block.text, home + article + (tail,), block.linked), MAIN))
            if inside and r.random() < 0.3:
                rows.append(inside.pop())
        elif r.random() < 0.5:
            rows.append((block, label))
    rows += after
    return [b for b, _ in rows], [label for _, label in rows]


# -- vectors --------------------------------------------------------------------------------


def _where(page_blocks: list[list[Block]]) -> np.ndarray:
    """How far down its page each block is."""
    return np.concatenate([np.arange(len(p)) / max(len(p) - 1, 1) for p in page_blocks if p] or [np.zeros(0)])


def vectors(page_blocks: list[list[Block]]) -> np.ndarray:
    """A row for each block of the pages, in order."""
    return _rows([b for page in page_blocks for b in page], _where(page_blocks))


def _rows(flat: list[Block], place: np.ndarray) -> np.ndarray:
    x = np.zeros((len(flat), PATHS + WORDS + EXTRAS), np.float32)
    if not flat:
        return x
    places: dict[tuple[str, ...], np.ndarray] = {}
    for row, block in enumerate(flat):
        at = places.get(block.path)
        if at is None:
            named = [*block.path, f"last {block.path[-1]}"] if block.path else ["top"]
            at = places[block.path] = np.array([crc32(n.encode()) % PATHS for n in named])
        x[row, at] = 1.0
    words = Words([b.text.lower().encode() for b in flat])
    bucket = (words.hash >> np.uint64(20)).astype(np.int64) % WORDS
    counts = np.bincount(words.doc * WORDS + bucket, minlength=len(flat) * WORDS).reshape(len(flat), WORDS)
    n = words.per_doc.astype(np.float32)
    x[:, PATHS : PATHS + WORDS] = counts / np.sqrt(np.maximum(n, 1))[:, None]
    size = np.array([len(b.text) for b in flat], np.float32)
    linked = np.array([b.linked for b in flat], np.float32)
    stops = np.array([b.text.count(".") + b.text.count(",") for b in flat], np.float32)
    extras = [np.log1p(n) / 5, linked / np.maximum(size, 1), stops / np.maximum(n, 1), place, place < 0.05, np.log1p(size) / 8]
    x[:, PATHS + WORDS :] = np.stack(extras, 1)
    return x


def _padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Time by page by feature, and a mask of what is there."""
    longest = max(sizes)
    out = np.zeros((longest, len(sizes), x.shape[1]), np.float32)
    mask = np.zeros((longest, len(sizes), 1), np.float32)
    at = 0
    for page, size in enumerate(sizes):
        out[:size, page] = x[at : at + size]
        mask[:size, page] = 1
        at += size
    return out, mask


# -- network --------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Projection, one LSTM in each direction, and a logistic unit over both and the block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def table(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {"project": table(PATHS + WORDS + EXTRAS, PROJECTED), "out": table(2 * HIDDEN + PROJECTED, 1), "bias": np.zeros(1, np.float32)}
        for way in ("ahead", "back"):
            self.w[f"{way}_x"] = table(PROJECTED, 4 * HIDDEN)
            self.w[f"{way}_h"] = table(HIDDEN, 4 * HIDDEN)
            self.w[f"{way}_b"] = np.zeros(4 * HIDDEN, np.float32)
            self.w[f"{way}_b"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """What one direction says of each step; with ``keep`` also all that its gradients need."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c, out, steps = h, np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        inputs = x @ self.w[f"{way}_x"] + self.w[f"{way}_b"]
        order = range(len(x)) if way == "ahead" else range(len(x) - 1, -1, -1)
        for t in order:
            z = inputs[t] + h @ self.w[f"{way}_h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            squeezed = np.tanh(new)
            if keep:
                steps.append((t, h, c, i, f, o, g, squeezed))
            m = mask[t]
            c = m * new + (1 - m) * c
            h = m * (o * squeezed) + (1 - m) * h
            out[t] = h
        return out, steps

    def _learned(self, way: str, x, mask, steps, d_out, grads) -> np.ndarray:
        """Adds gradients of one direction, returns that of its input."""
        wh, wx = self.w[f"{way}_h"], self.w[f"{way}_x"]
        dx = np.zeros_like(x)
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, squeezed in reversed(steps):
            m = mask[t]
            dh = dh + d_out[t]
            d_new_h, d_new_c = dh * m, dc * m
            d_new_c = d_new_c + d_new_h * o * (1 - squeezed**2)
            dz = np.concatenate([d_new_c * g * i * (1 - i), d_new_c * c * f * (1 - f), d_new_h * squeezed * o * (1 - o), d_new_c * i * (1 - g**2)], 1)
            grads[f"{way}_x"] += x[t].T @ dz
            grads[f"{way}_h"] += h.T @ dz
            grads[f"{way}_b"] += dz.sum(0)
            dx[t] = dz @ wx.T
            dh = dh * (1 - m) + dz @ wh.T
            dc = dc * (1 - m) + d_new_c * f
        return dx

    def _projected(self, page_blocks: list[list[Block]]) -> np.ndarray:
        """The projection of each block, some at a time: a block's vector is much longer."""
        flat, place = [b for page in page_blocks for b in page], _where(page_blocks)
        out = np.zeros((len(flat), PROJECTED), np.float32)
        for at in range(0, len(flat), PROJECTED_AT_ONCE):
            some = slice(at, at + PROJECTED_AT_ONCE)
            out[some] = np.tanh(_rows(flat[some], place[some]) @ self.w["project"])
        return out

    def _forward(self, low: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """From projected blocks to the probability of main text."""
        ahead, ahead_steps = self._run("ahead", low, mask, keep)
        back, back_steps = self._run("back", low, mask, keep)
        joined = np.concatenate([ahead, back, low], 2)
        return ahead_steps, back_steps, joined, _sigmoid(joined @ self.w["out"] + self.w["bias"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over known labels, and its gradients."""
        low = np.tanh(x @ self.w["project"])
        ahead, back, joined, p = self._forward(low, mask, keep=True)
        known = (labels >= 0) & (mask[:, :, 0] > 0)
        n = max(int(known.sum()), 1)
        loss = -np.log(np.clip(np.where(labels > 0, p, 1 - p)[known], 1e-7, 1)).sum() / n
        dz = (np.where(known, p - labels, 0) / n).astype(np.float32)[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"] = np.tensordot(joined, dz, ([0, 1], [0, 1]))
        grads["bias"] = dz.sum((0, 1))
        d_joined = dz @ self.w["out"].T
        d_low = d_joined[:, :, 2 * HIDDEN :]
        d_low = d_low + self._learned("ahead", low, mask, ahead, d_joined[:, :, :HIDDEN], grads)
        d_low = d_low + self._learned("back", low, mask, back, d_joined[:, :, HIDDEN : 2 * HIDDEN], grads)
        grads["project"] = np.tensordot(x, d_low * (1 - low**2), ([0, 1], [0, 1]))
        return float(loss), grads

    def fit(self, pages: list[list[Block]], labels: list[list[float]], seed: int = 11) -> Labeller:
        r = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(pages))
            for start in range(0, len(order), BATCH):
                chosen = [int(i) for i in order[start : start + BATCH] if pages[i]]
                if not chosen:
                    continue
                sizes = [len(pages[i]) for i in chosen]
                flat = vectors([pages[i] for i in chosen])
                flat[r.random(len(flat)) < HIDDEN_PATHS, :PATHS] = 0
                x, mask = _padded(flat, sizes)
                x[:, r.random(len(chosen)) < HIDDEN_PATHS, :PATHS] = 0
                known, _ = _padded(np.concatenate([labels[i] for i in chosen])[:, None].astype(np.float32), sizes)
                _, grads = self.gradients(x, mask, known[:, :, 0])
                step += 1
                for k, grad in grads.items():
                    one, two = moments[k]
                    grad = np.clip(grad, -1, 1)
                    one += 0.1 * (grad - one)
                    two += 0.01 * (grad**2 - two)
                    rate = LEARNING * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.w[k] -= (rate * one / (np.sqrt(two) + 1e-7)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text. Pages of like length run side by side."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop - start + 1) * len(pages[order[stop]]) <= LABELLED_AT_ONCE:
                stop += 1
            chosen = order[start:stop]
            sizes = [len(pages[i]) for i in chosen]
            p = self._forward(*_padded(self._projected([pages[i] for i in chosen]), sizes))[-1]
            for column, (i, size) in enumerate(zip(chosen, sizes, strict=True)):
                out[i] = p[:size, column] > 0.5
            start = stop
        return out


def training_set(pages: list[str], seed: int = 5) -> tuple[list[list[Block]], list[list[float]]]:
    """Labelled pages: each as it is, and in changed forms."""
    r = random.Random(seed)
    shown, labels = [], []
    for page in pages:
        own = blocks(page)[:SAMPLE_BLOCKS]
        shown.append(own)
        labels.append([silver(b) for b in own])
        for _ in range(VARIANTS):
            changed, known = _variant(own, r)
            shown.append(changed)
            labels.append(known)
    return shown, labels


def _trained(batches: Batches, schema: pa.Schema) -> Batches:
    pages = [p for batch in batches for p in batch.column(0).to_pylist()]
    yield batch_of(schema, [[pickle.dumps(Labeller().fit(*training_set(pages)).w)]])


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights fitted in one task on ``sample`` pages at most, those of the lowest hash."""
    chosen = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"))
    chosen = chosen.orderBy(F.xxhash64("html"), "html").limit(sample).coalesce(1)
    task = partial(_trained, schema=pa.schema([("weights", pa.binary())]))
    rows = arrow_map(chosen, task, "weights binary").collect()
    return pickle.loads(rows[0]["weights"]) if rows else Labeller().w


def _extracted(batches: Batches, weights: dict[str, np.ndarray], schema: pa.Schema) -> Batches:
    labeller = Labeller()
    labeller.w = weights
    for batch in batches:
        pages = batch.column(2).to_pylist()
        for start in range(0, len(pages), 512):
            cut = [blocks(p) for p in pages[start : start + 512]]
            texts = [
                "\n\n".join(b.text for b, main in zip(page, mains, strict=True) if main)
                for page, mains in zip(cut, labeller.label(cut), strict=True)
            ]
            part = batch.slice(start, 512)
            yield batch_of(schema, [part.column(0), part.column(1), texts, list(map(len, texts))])


def extract(
    pages: DataFrame,
    weights: dict[str, np.ndarray] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    workspace: Workspace | None = None,
) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every row.

    Without ``weights`` they are fitted first. A null or empty page has an empty text; repeated
    rows and null ids stay. White space, also of references, becomes one space in a block.
    """
    if weights is None:
        weights = train(pages, html_col)
    plain = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html")
    )
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    task = partial(_extracted, weights=weights, schema=schema)
    return arrow_map(plain, task, "page_id long, url string, text string, n_chars long")
