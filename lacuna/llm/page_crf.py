"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks (``page_blocks``). Each block has features of its ancestors (tags, words of class, id and
role) and of its text (length, share of links, punctuation, marks of rights). A chain of two labels, main and other, is
trained by gradient ascent on its likelihood over ``TRAIN_PAGES`` labelled pages (``training_pages``; the bound is this
parameter and doesn't depend on the input) and decoded by Viterbi. Training takes seconds, on the driver, once a session; the
weights, some hundred numbers, go to the tasks and each page is decoded on its own, whole.

Null or empty pages, and pages without a main block, give the empty text. Broken markup gives the blocks it still has, in time
in proportion to the page's length. White space within a block, that of Unicode such as the no-break space included, becomes one
space. Every row gives one row, repeated rows too; further columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.page_blocks import Block, blocks
from lacuna.llm.training_pages import labelled_page

TRAIN_PAGES = 900
EPOCHS = 6
_STEP, _PENALTY = 0.2, 1e-4
#: Tags that say what a part of a page is; a block below none of them, and without names, has only its text to go by.
STRUCTURE = frozenset(("nav", "header", "footer", "aside", "article", "main", "section", "form"))


def features(block: Block) -> list[str]:
    """Names of the features that a block has."""
    own = block.tags[-1] if block.tags else "none"
    words = block.text.count(" ") + 1
    size = min(words.bit_length(), 6)
    share = 4 * block.linked // max(len(block.text), 1)
    out = [f"own={own}", f"size={size}", f"links={share}", f"own={own},links={share > 2}", f"end={block.text[-1] in '.!?:;”»'}"]
    out += [f"above={t}" for t in dict.fromkeys(block.tags)] + ["path=" + "/".join(block.tags[-3:])]
    if not block.names and STRUCTURE.isdisjoint(block.tags):
        out.append(f"bare={size},{share > 1},{block.text[-1] in '.!?:;”»'}")
    out += [f"named={n}" for n in block.names]
    if "©" in block.text:
        out.append("rights")
    return out


class Chain:
    """Weights of (feature, label) and of (label, next label); ``decode`` finds the likeliest labels of a page."""

    def __init__(self, emit: dict[str, tuple[float, float]], step: list[list[float]]):
        self.emit, self.step = emit, step
        self.names = frozenset(f.removeprefix("named=") for f in emit if f.startswith("named="))

    def decode(self, page: list[list[str]]) -> list[int]:
        (s00, s01), (s10, s11) = self.step
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, names in enumerate(page):
            e0 = e1 = 0.0
            for name in names:
                w = self.emit.get(name)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if k == 0:
                a, b = e0, e1
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10) + e0, max(a + s01, b + s11) + e1
        if not page:
            return []
        labels = [int(b > a)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


@lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 0) -> Chain:
    """The chain fitted on ``pages`` labelled pages: gradient of the log-likelihood by forward and backward sums."""
    index: dict[str, int] = {}
    data = []
    for k in range(pages):
        page, labels = labelled_page(seed + k, wide=k % 3 == 2)
        rows = [[index.setdefault(f, len(index)) for f in features(b)] for b in blocks(page)]
        if len(rows) != len(labels):
            raise ValueError(f"page {seed + k} has {len(rows)} blocks and {len(labels)} labels")
        if rows:
            data.append((rows, np.array(labels)))
    emit, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    emit_sum, step_sum = np.full_like(emit, 1e-2), np.full_like(step, 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            rows, gold = data[i]
            n = len(rows)
            score = np.array([emit[r].sum(axis=0) for r in rows])
            forward, backward = score.copy(), np.zeros((n, 2))
            for t in range(1, n):
                forward[t] += np.logaddexp(forward[t - 1, 0] + step[0], forward[t - 1, 1] + step[1])
            for t in range(n - 2, -1, -1):
                ahead = score[t + 1] + backward[t + 1]
                backward[t] = np.logaddexp(step[:, 0] + ahead[0], step[:, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            miss = -np.exp(forward + backward - total)
            miss[np.arange(n), gold] += 1
            pull = np.zeros_like(step)
            for t in range(1, n):
                pull -= np.exp(forward[t - 1][:, None] + step + (score[t] + backward[t])[None, :] - total)
                pull[gold[t - 1], gold[t]] += 1
            grad = -_PENALTY * emit
            for r, m in zip(rows, miss, strict=True):
                grad[r] += m
            emit_sum += grad**2
            step_sum += pull**2
            emit += _STEP * grad / np.sqrt(emit_sum)
            step += _STEP * pull / np.sqrt(step_sum)
    return Chain({f: (float(emit[k, 0]), float(emit[k, 1])) for f, k in index.items()}, step.tolist())


def main_text(page: str | None, chain: Chain) -> str:
    """The blocks labelled main, in page order, one on each line."""
    found = blocks(page, chain.names) if page else []
    labels = chain.decode([features(b) for b in found])
    return "\n".join(b.text for b, label in zip(found, labels, strict=True) if label)


def extracted(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            for a in range(0, batch.num_rows, 256):
                texts = [main_text(p.as_py(), chain) for p in html.slice(a, 256)]
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
