"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A block's label is main or other. Its features are the elements around it, the words
of their names, and the shape of its text; the chain adds what follows what. The
field is trained by maximum likelihood on labelled pages, of which at most
``MAX_PAGES`` are taken, on the driver; its weights (a number per feature that
occurs in them) go to the tasks, where every page is parsed and decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from caseloom.llm.page_blocks import Block, page_blocks
from caseloom.llm.page_labels import labelled_pages
from caseloom.llm.tables import map_texts

MAX_PAGES = 1200    # labelled pages to learn from
LEAST_SEEN = 12     # blocks in which a feature must occur
ROUNDS, RATE, DECAY = 200, 0.2, 1e-5

_WORD = re.compile(r"[^\W\d_]+|©")
_END = re.compile(r"[.!?…:;][\"'”»)]*\Z")


class Field(NamedTuple):
    """Weights for main against other: by feature; for main after other and the like, [before][after]; at both ends."""

    weights: dict
    steps: tuple
    first: float
    last: float


def _size(n: int) -> int:
    """Powers of two, up to 32."""
    return min(n.bit_length(), 6)


def features(blocks: list[Block]) -> list[list[str]]:
    """Features of every block of a page."""
    out = []
    heading: list[str] = []
    seen_title = False
    sizes = [_size(len(b.text.split())) for b in blocks]
    for i, b in enumerate(blocks):
        own = b.tags[-1] if b.tags else ""
        linked = 0 if b.linked == 0 else 1 if b.linked < 0.4 else 2 if b.linked < 0.9 else 3
        words = [w.lower() for w in _WORD.findall(b.text)] if sizes[i] < 6 else []
        f = [f"own {own}", f"linked {linked}", f"size {sizes[i]}", f"own {own} linked {linked}", f"own {own} size {sizes[i]}",
             f"size {sizes[i]} linked {linked}", f"ends {bool(_END.search(b.text))} {sizes[i] > 3}", f"titled {seen_title}",
             f"before {sizes[i - 1] if i else 'none'}", f"behind {sizes[i + 1] if i + 1 < len(blocks) else 'none'}"]
        f += [f"in {t}" for t in set(b.tags) - {"html", "body"}]
        f += [f"name {w}" for w in b.words]
        f += [f"near {w}" for w in b.near]
        f += [f"word {w}" for w in set(words)]
        if own[:1] == "h" and own[1:].isdigit():
            heading = list(dict.fromkeys(words))
            seen_title = seen_title or own == "h1"
        f += [f"under {w}" for w in heading]
        if "©" in b.text:
            f.append("mark ©")
        out.append(f)
    return out


def train(pages: Iterable[str], rounds: int = ROUNDS) -> Field:
    """Weights of greatest likelihood, with a penalty on their squares, by Adam over all pages at once."""
    chains = [(features(blocks), [b.main for b in blocks]) for blocks in map(page_blocks, pages) if blocks]
    counted = Counter(name for made, _ in chains for f in made for name in f)
    names = sorted(n for n, c in counted.items() if c >= LEAST_SEEN)
    number = {n: i for i, n in enumerate(names)}
    at = [[number[n] for n in f if n in number] for made, _ in chains for f in made]
    owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
    feature = np.array([i for a in at for i in a], np.int64)
    # chains side by side, padded to the longest
    longest = max(len(made) for made, _ in chains)
    inside = np.zeros((len(chains), longest), bool)
    truth = np.zeros((len(chains), longest), np.int64)
    for row, (_, labels) in enumerate(chains):
        inside[row, :len(labels)], truth[row, :len(labels)] = True, labels
    ends = inside.sum(1) - 1
    rows = np.arange(len(chains))
    pairs = inside[:, 1:]

    size = len(names)
    weights = np.zeros(size + 6)     # features, steps (4), first, last
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for n in range(1, rounds + 1):
        steps = weights[size:size + 4].reshape(2, 2)
        scores = np.zeros((len(chains), longest, 2))
        scores[inside, 1] = np.bincount(owner, weights[feature], len(at))
        scores[:, 0, 1] += weights[-2]
        scores[rows, ends, 1] += weights[-1]
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(pairs[:, t - 1, None], scores[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(pairs[:, t, None], np.logaddexp.reduce(steps + (scores[:, t + 1] + behind[:, t + 1])[:, None], axis=2), 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        joint = np.exp(ahead[:, :-1, :, None] + steps + (scores + behind)[:, 1:, None, :] - total[:, None, None, None])
        joint[~pairs] = 0
        off = truth - share
        slope = np.zeros_like(weights)
        slope[:size] = np.bincount(feature, off[inside][owner], size)
        real = np.zeros((2, 2))
        np.add.at(real, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
        slope[size:size + 4] = (real - joint.sum((0, 1))).ravel()
        slope[-2], slope[-1] = off[:, 0].sum(), off[rows, ends].sum()
        slope = slope / len(at) - DECAY * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        weights += RATE * mean / (1 - 0.9 ** n) / (np.sqrt(square / (1 - 0.999 ** n)) + 1e-8)
    s = weights[size:size + 4].tolist()
    return Field(dict(zip(names, weights[:size].tolist())), ((s[0], s[1]), (s[2], s[3])), float(weights[-2]), float(weights[-1]))


def decoded(field: Field, blocks: list[Block]) -> list[bool]:
    """The likeliest labels of a page's blocks (Viterbi); of equals other."""
    if not blocks:
        return []
    scores = [sum(field.weights.get(n, 0.0) for n in f) for f in features(blocks)]
    scores[0] += field.first
    scores[-1] += field.last
    best, back = (0.0, scores[0]), []
    for score in scores[1:]:
        came = [max((0, 1), key=lambda b: best[b] + field.steps[b][label]) for label in (0, 1)]
        best = tuple(best[came[label]] + field.steps[came[label]][label] + (score if label else 0.0) for label in (0, 1))
        back.append(came)
    label = int(best[1] > best[0])
    labels = [label]
    for came in reversed(back):
        label = came[label]
        labels.append(label)
    return [bool(x) for x in reversed(labels)]


def main_text(field: Field, html: str) -> str:
    """The main blocks of a page, an empty line between."""
    blocks = page_blocks(html)
    return "\n\n".join(b.text for b, main in zip(blocks, decoded(field, blocks)) if main)


def trained_field(labelled: DataFrame | None = None, html: str = "html") -> Field:
    """A field trained on at most ``MAX_PAGES`` labelled pages, those of the least text hashes, or on made ones if none are given.

    In a labelled page the elements of the main text bear the attribute ``data-main``.
    """
    if labelled is None:
        return train(labelled_pages(MAX_PAGES))
    picked = labelled.where(F.col(html).isNotNull()).orderBy(F.xxhash64(html), html).limit(MAX_PAGES)
    return train([r[0] for r in picked.select(html).collect()])


def extracted_texts(pages: DataFrame, field: Field, html: str = "html", carry: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """``carry``, ``text`` and ``n_chars`` (its code points) of every page.

    A NULL, empty or text-less page has an empty text. Repeated pages are pages of
    their own. Other columns play no part. Blocks are joined by an empty line in
    page order; character references are decoded and white space in a block is one
    space; scripts, styles, comments and the like are never text.
    """
    def work(texts: pa.Array) -> list[pa.Array]:
        out = [main_text(field, raw.decode("utf-8", "replace")) for raw in texts.to_pylist()]
        return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_texts(pages, html, list(carry), result, work)
