"""Main text of pages: gradient-boosted trees over DOM-node features, decoded over the hierarchy.

Every block element is a node.  Its features: what tags and attribute tokens (class, id, role) tell, of itself and its ancestors;
text, tag, link and punctuation density of its subtree; depth; and statistics of its siblings.  The trees are fitted here on
pages drawn by ``page_maker`` with known main text (a fixed number of pages, on the driver; no table is read).  A node's label says
whether main text lies below it, so a dropped node can have no kept descendant: decoding finds the labelling of greatest total
log-odds under that constraint by dynamic programming over the tree.

Defined results: a null or empty page has the empty text; text outside any element belongs to the document node, which is always
kept; a null ``page_id`` or url stays null; rows are extracted one by one, so repeated rows, ties and extra columns change nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import boosting, page_maker
from tessera.llm.common import map_arrow, strings
from tessera.llm.html_tree import Page, parse, subtree

PAGES, SEED = 1200, 7
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


@dataclass
class Model:
    tags: dict[str, float]
    tokens: dict[str, float]
    forest: boosting.Forest | None = None


def _odds(pages: list[Page], labels: list[np.ndarray]) -> Model:
    """Smoothed log-odds of main text below a node, by tag and by attribute token, from nodes whose parents have main text."""
    counts: dict[tuple[str, str], np.ndarray] = {}
    for page, label in zip(pages, labels, strict=True):
        for n in range(1, len(page.tags)):
            if label[page.parents[n]]:
                for key in [("tag", page.tags[n]), *(("token", t) for t in page.tokens[n])]:
                    counts.setdefault(key, np.ones(2))[int(label[n])] += 1
    odds = {k: float(np.log(c[1] / c[0])) for k, c in counts.items()}
    return Model({k[1]: v for k, v in odds.items() if k[0] == "tag"}, {k[1]: v for k, v in odds.items() if k[0] == "token"})


def features(page: Page, model: Model) -> np.ndarray:
    """nodes x features."""
    n = len(page.tags)
    parents, ends, depth = np.array(page.parents), np.array(page.ends), np.array(page.depths, float)
    tag = np.array([model.tags.get(t, 0.0) for t in page.tags])
    known = [[model.tokens.get(t, 0.0) for t in ts] if ts else None for ts in page.tokens]
    token_sum = np.array([sum(k) if k else 0.0 for k in known])
    token_min = np.array([min(k) if k else 0.0 for k in known])
    above_token, above_tag, place, siblings = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    before = [0] * n
    last: dict[int, int] = {}
    for i in range(1, n):
        p = page.parents[i]
        above_token[i] = min(above_token[p], float(token_min[p]))
        above_tag[i] = min(above_tag[p], float(tag[p]))
        place[i] = siblings[p]
        siblings[p] += 1
        before[i] = last.get(p, 0)
        last[p] = i
    after = np.zeros(n, int)
    before_at = np.array(before)
    after[before_at[before_at > 0]] = np.flatnonzero(before_at > 0)
    own = np.array(page.chars, float)
    chars, link, marks = subtree(own, ends), subtree(np.array(page.link_chars, float), ends), subtree(np.array(page.marks, float), ends)
    links, fields = subtree(np.array(page.links, float), ends), subtree(np.array(page.fields, float), ends)
    inside = subtree(np.array(page.inner, float) + 1, ends)
    paragraphs = subtree(np.array([t == "p" for t in page.tags], float), ends)
    items = subtree(np.array([t in ("li", "td", "th", "dt", "dd", "option") for t in page.tags], float), ends)
    whole, up = max(1.0, chars[0]), np.maximum(parents, 0)
    sib = np.array(siblings)
    return np.stack([
        tag, token_sum, token_min, np.array(above_token), np.array(above_tag), depth,
        np.log1p(chars), np.log1p(own), link / (chars + 1), inside / (chars + 1), marks / (chars + 1), np.log1p(links), np.log1p(fields),
        np.log1p(paragraphs), items / (inside + 1), np.array(place, float), sib[up].astype(float), sib.astype(float),
        chars / np.maximum(1.0, chars[up]), np.log1p(np.where(before_at > 0, chars[before_at], 0)), np.log1p(np.where(after > 0, chars[after], 0)),
        chars / whole, np.concatenate(([0.0], np.cumsum(own)[:-1])) / whole,
        tag[up], token_min[up],
    ], axis=1)


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """The best labelling in which nothing below a dropped node is kept; margins are log-odds of keeping."""
    n = len(page.tags)
    gain = margin.tolist()  # of keeping over dropping the node and all below it
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if gain[i] > 0:
            gain[p] += gain[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parents[i]] and gain[i] > 0
    return keep


def _labels(page: Page, main: list[str]) -> np.ndarray:
    """Nodes that have a block of main text below them."""
    out = np.zeros(len(page.tags), bool)
    out[0] = True
    left = set(main)
    for n, text in page.blocks:
        if text in left:
            while n > 0 and not out[n]:
                out[n] = True
                n = page.parents[n]
    return out


@functools.lru_cache(maxsize=2)
def fit(pages: int = PAGES, seed: int = SEED) -> Model:
    made = page_maker.make(pages, seed)
    parsed = [parse(source) for source, _ in made]
    labels = [_labels(p, main) for p, (_, main) in zip(parsed, made, strict=True)]
    half = len(parsed) // 2  # odds come from one half, the trees from the other, so that the trees don't trust the odds too much
    model = _odds(parsed[:half], labels[:half])
    x = np.concatenate([features(p, model)[1:] for p in parsed[half:]])
    y = np.concatenate([v[1:] for v in labels[half:]]).astype(float)
    model.forest = boosting.fit(x, y)
    return model


def extract(sources: list[str], model: Model) -> list[tuple[str, int, int]]:
    """(text, blocks, kept blocks) of each page."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    each = [features(p, model) for p in pages]
    margins = np.split(model.forest.margin(np.concatenate(each)), np.cumsum([len(x) for x in each])[:-1])
    out = []
    for page, margin in zip(pages, margins, strict=True):
        keep = decode(page, margin)
        out.append((page.text(keep), len(page.blocks), sum(bool(keep[n]) for n, _ in page.blocks)))
    return out


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of ``SCHEMA``, a row per page."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit())

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = extract(strings(b.column(2)), held.value)
            texts = [t for t, _, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2))], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), f, SCHEMA)
