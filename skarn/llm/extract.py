"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 6).

A page's leaf blocks, in order, are labelled main text or furniture by a two-state chain.  Emissions weigh
binary features of a block: tags and class, id and role words of its ancestors, its own tag, length, link
share and endings; transitions weigh pairs of neighbouring labels.  Weights maximise the regularised
conditional likelihood of labelled pages (``pagegen``: seeded, of random layouts) and are fitted on the
driver in a few seconds; Viterbi decodes.  The kept blocks are joined by \\n.

A null or empty page, or one without main text, gives an empty text.  Pages are read whole, however long.
Null and repeated ids and urls are passed on as they are.  Of equally probable labellings
one is taken from the last block back, furniture first.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.blocks import NAMES, leaf_blocks
from skarn.llm.pagegen import labelled_page

TRAINING_PAGES = 500


def _active(mask: int) -> list[int]:
    return [i for i in range(len(NAMES)) if mask >> i & 1]


def labelled_blocks(seed: int) -> tuple[list[int], list[int], list[str]]:
    """Feature bits, labels and texts of a generated page's blocks; labels follow the texts in order."""
    page, truth = labelled_page(seed)
    masks, labels, texts = [], [], []
    k = 0
    for text, mask in leaf_blocks(page):
        while k < len(truth) and " ".join(truth[k][0].split()) != text:
            k += 1
        if k == len(truth):
            break
        masks.append(mask)
        labels.append(int(truth[k][1]))
        texts.append(text)
        k += 1
    return masks, labels, texts


class Chain:
    """emit[2, features], move[2, 2], begin[2]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin
        self._scores: dict[int, tuple[float, float]] = {}

    def __reduce__(self):
        return Chain, (self.emit, self.move, self.begin)

    def score(self, mask: int) -> tuple[float, float]:
        if mask not in self._scores:
            if len(self._scores) > 50_000:
                self._scores.clear()
            s = self.emit[:, _active(mask)].sum(axis=1)
            self._scores[mask] = float(s[0]), float(s[1])
        return self._scores[mask]

    def decode(self, masks: list[int]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not masks:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        back: list[tuple[int, int]] = []
        e = self.score(masks[0])
        a, b = e[0] + float(self.begin[0]), e[1] + float(self.begin[1])
        for mask in masks[1:]:
            e = self.score(mask)
            f0, f1 = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10), (0, a + m01) if a + m01 >= b + m11 else (1, b + m11)
            back.append((f0[0], f1[0]))
            a, b = f0[1] + e[0], f1[1] + e[1]
        y = [int(b > a)]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]

    def extract(self, page: str | None) -> str:
        found = leaf_blocks(page) if page else []
        return "\n".join(t for (t, _), y in zip(found, self.decode([m for _, m in found])) if y)

    def column(self, page: Column) -> Column:
        me = self
        return F.arrow_udf(lambda pages: pa.array([me.extract(p.as_py()) for p in pages], pa.string()), "string")(page)


@functools.lru_cache(4)
def train(pages: int = TRAINING_PAGES, steps: int = 100, ridge: float = 0.5, first_seed: int = 1) -> Chain:
    """Maximum conditional likelihood by full-batch Adam; forward and backward run over all pages at once."""
    data = [labelled_blocks(first_seed + i)[:2] for i in range(pages)]
    data = [d for d in data if d[0]]
    n, t, f = len(data), max(len(m) for m, _ in data), len(NAMES)
    rows = np.array([(i, j, k) for i, (masks, _) in enumerate(data) for j, m in enumerate(masks) for k in _active(m)])
    cell = rows[:, 0] * t + rows[:, 1]
    x = np.zeros((n * t, f), np.float32)
    x[cell, rows[:, 2]] = 1
    y = np.zeros((n, t), int)
    on = np.zeros((n, t), bool)
    for i, (masks, labels) in enumerate(data):
        y[i, : len(labels)] = labels
        on[i, : len(labels)] = True
    target = np.zeros((n, t, 2), np.float32)
    target[np.arange(n)[:, None], np.arange(t)[None, :], y] = on
    pair = np.zeros((2, 2))
    both = on[:, 1:]
    np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), 1)
    start = np.bincount(y[:, 0], minlength=2).astype(float)
    w = np.zeros(2 * f + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        emit, move, begin = w[: 2 * f].reshape(2, f), w[2 * f : 2 * f + 4].reshape(2, 2), w[2 * f + 4 :]
        e = (x @ emit.T.astype(np.float32)).reshape(n, t, 2).astype(float)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = e[:, 0] + begin
        for j in range(1, t):
            step_in = np.logaddexp(fwd[:, j - 1, :1] + move[0], fwd[:, j - 1, 1:] + move[1]) + e[:, j]
            fwd[:, j] = np.where(on[:, j, None], step_in, fwd[:, j - 1])
        for j in range(t - 2, -1, -1):
            ahead = e[:, j + 1] + bwd[:, j + 1]
            step_in = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            bwd[:, j] = np.where(on[:, j + 1, None], step_in, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        node = np.exp(np.clip(fwd + bwd - z[:, None, None], -50, 0)) * on[:, :, None]
        edge = fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(np.clip(edge, -50, 0)) * both[:, :, None, None]).sum(axis=(0, 1))
        g = np.concatenate([((target - node).reshape(n * t, 2).T.astype(np.float32) @ x).ravel(), (pair - expected).ravel(), start - node[:, 0].sum(axis=0)]) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(w[: 2 * f].reshape(2, f).copy(), w[2 * f : 2 * f + 4].reshape(2, 2).copy(), w[2 * f + 4 :].copy())


def extract_text(pages: DataFrame, model: Chain | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or train()
    out = pages.select("page_id", "url", model.column(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
