"""Toxicity by a classifier chain of linear models.

The chain predicts its categories in order; the probabilities of the earlier ones are features of each later model. In
training these are out-of-fold predictions, so that a later model sees earlier probabilities as good as it will meet in
use. The labels give one verdict per document and name no categories, so those before the verdict are learned: the words
that go with the verdict are grouped by the toxic documents in which they occur, and a document labelled toxic belongs to
the categories whose words it has. The last link of the chain is the verdict itself.

Features are presences of words, hashed to ``2**FEATURE_BITS`` columns. A column is used only if it goes with a label more
often than chance allows over distinct training texts, so that a text's length or topic adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .hashing import word_hashes, word_shingles

#: Categories that are learned before the verdict.
THEMES = 3
FEATURE_BITS = 18
#: Labelled documents that the models are fitted on: a sample of this size by hash of the id where there are more.
TRAIN_ROWS = 20_000
FOLDS = 5
#: Least number of distinct training texts with a word, and its least log odds in standard deviations.
MIN_TEXTS = 5
MIN_SCORE = 4.0
#: Columns that a category brings in, the strongest first.
MAX_COLUMNS = 48
THRESHOLD = 0.5
EDGE = ".,;:!?\"'()[]{}<>*#%&$-_"


@dataclass(frozen=True)
class Chain:
    """Weights by category: hashed word columns, then one for each earlier category's probability, and the bias."""

    names: tuple[str, ...]
    words: np.ndarray  # category x column
    earlier: np.ndarray  # category x category, lower triangle
    bias: np.ndarray


def _clean(texts: list) -> list[str]:
    """Punctuation becomes white space, so that a word is found beside any mark; null counts as empty."""
    return [(t or "").translate(_SPACES) for t in texts]


_SPACES = {ord(c): " " for c in EDGE}


WIDTH = 1 << FEATURE_BITS


def columns(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, distinct feature columns) of each text."""
    return _distinct(*word_hashes(_clean(texts)))


def _distinct(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cols = (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
    parts = [np.unique(cols[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts) if parts else cols[:0]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def training_rows(documents: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> list:
    """At most ``rows`` labelled documents as (id, label, columns, signature); the hash of the id decides which."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__l")).agg(F.max(label_col).cast("int").alias("label"))
    lab = lab.orderBy(F.xxhash64("__l"), "__l").limit(rows)  # at most the documented bound
    docs = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            word_at, hashes = word_hashes(_clean(texts))
            offsets, cols = _distinct(word_at, hashes)
            out = []
            for i, (ident, label) in enumerate(zip(frame["__id"], frame["label"], strict=True)):
                sh = word_shingles(hashes[word_at[i] : word_at[i + 1]])
                signature = [int((sh * np.uint64(k)).min()) >> 1 if len(sh) else 0 for k in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                out.append((ident, int(label), cols[offsets[i] : offsets[i + 1]].tobytes(), signature))
            yield pd.DataFrame(out, columns=["id", "label", "cols", "signature"])

    joined = docs.join(F.broadcast(lab), F.col("__id") == F.col("__l")).select("__id", "text", "label")  # so texts do not move
    return joined.mapInPandas(trimmed(run), "id long, label int, cols binary, signature array<long>").collect()


def _logistic(design: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.3) -> np.ndarray:
    """Newton's method on weighted rows with an L2 penalty on all but the last (bias) column."""
    w = np.zeros(design.shape[1])
    ridge = np.full(design.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = sigmoid(design @ w)
        grad = design.T @ (weight * (p - y)) + ridge * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _telling(held: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The columns that go with ``y`` more often than chance allows, the strongest first; none with too few rows."""
    n1 = y.sum()
    n0 = len(y) - n1
    if n1 < MIN_TEXTS or n0 < MIN_TEXTS:
        return np.empty(0, np.int64)
    with_1, with_0 = np.zeros(WIDTH), np.zeros(WIDTH)
    for cols, yes in zip(held, y, strict=True):
        (with_1 if yes else with_0)[cols] += 1
    odds = np.log((with_1 + 0.5) / (n1 - with_1 + 0.5)) - np.log((with_0 + 0.5) / (n0 - with_0 + 0.5))
    spread = np.sqrt(1 / (with_1 + 0.5) + 1 / (n1 - with_1 + 0.5) + 1 / (with_0 + 0.5) + 1 / (n0 - with_0 + 0.5))
    good = np.flatnonzero((with_1 + with_0 >= MIN_TEXTS) & (odds / spread >= MIN_SCORE))
    return good[np.argsort(-(odds / spread)[good], kind="stable")][:MAX_COLUMNS]


def learned_themes(held: list[np.ndarray], toxic: np.ndarray, themes: int = THEMES) -> np.ndarray:
    """(row x theme) weak labels. Each theme starts from the telling word of most toxic rows that no theme has yet; every
    other telling word joins the theme with whose rows it shares the largest part of its own."""
    words = _telling(held, toxic)
    has = np.zeros((len(held), len(words)), bool)
    for i, cols in enumerate(held):
        has[i] = np.isin(words, cols)
    has &= toxic.astype(bool)[:, None]
    out = np.zeros((len(held), themes), bool)
    free, left, seeds = toxic.astype(bool).copy(), list(range(len(words))), []
    for t in range(min(themes, len(words))):
        seeds.append(max(left, key=lambda w: (has[free, w].sum(), -w)))
        left.remove(seeds[-1])
        out[:, t] = has[:, seeds[-1]]
        free &= ~out[:, t]
    first = out.copy()
    for w in left:
        t = max(range(len(seeds)), key=lambda t: ((has[:, w] & first[:, t]).sum() / max(first[:, t].sum(), 1), -t))
        out[:, t] |= has[:, w]
    return out


def fit_chain(rows: list, folds: int = FOLDS) -> Chain:
    """Fit on (id, label, cols, signature) rows. Without both labels present, every probability is the base rate.

    Of rows with one label and equal minima of their shingles under three hashes (copies and very near ones) the first
    counts, so that copies are not evidence of their own.
    """
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: (r["id"], r["label"], r["signature"])):
        key = (r["label"], *r["signature"])
        if key not in seen or not any(r["signature"]):
            kept.append(r)
        seen.add(key)
    names = (*(f"theme_{t + 1}" for t in range(THEMES)), "toxic")
    k, width = len(names), WIDTH
    held = [np.frombuffer(r["cols"], np.int32) for r in kept]
    verdict = np.array([r["label"] > 0 for r in kept], float)
    y_all = np.hstack([learned_themes(held, verdict), verdict[:, None]]).astype(float)
    words, earlier, bias = np.zeros((k, width), np.float32), np.zeros((k, k)), np.full(k, -6.0)
    chosen: set[int] = set()
    for c in range(k):
        chosen |= set(_telling(held, y_all[:, c]).tolist())
    used = np.array(sorted(chosen), np.int64)
    index = np.full(width, -1)
    index[used] = np.arange(len(used))
    x = np.zeros((len(kept), len(used)))
    for i, cols in enumerate(held):
        at = index[cols]
        x[i, at[at >= 0]] = 1
    # most texts show none of the columns: equal rows of a fold become one row with a weight
    rows_of = np.hstack([x, y_all, (np.arange(len(kept)) % folds)[:, None]])
    rows_of, weight = np.unique(rows_of, axis=0, return_counts=True)
    x, y_all, fold = rows_of[:, : len(used)], rows_of[:, len(used) : len(used) + k], rows_of[:, -1]
    oof = np.zeros((len(x), k))
    one = np.ones((len(x), 1))
    for c in range(k):
        y = y_all[:, c]
        design = np.hstack([x, oof[:, :c], one])
        n1, n = float(weight @ y), float(weight.sum())
        if n1 < MIN_TEXTS or n - n1 < MIN_TEXTS:
            oof[:, c] = n1 / n if n else 0.0
            bias[c] = np.log((n1 + 0.5) / (n - n1 + 0.5)) if n else -6.0
            continue
        for f in range(folds):
            oof[fold == f, c] = sigmoid(design[fold == f] @ _logistic(design[fold != f], y[fold != f], weight[fold != f]))
        w = _logistic(design, y, weight)
        words[c, used], earlier[c, :c], bias[c] = w[: len(used)], w[len(used) : -1], w[-1]
    return Chain(names, words, earlier, bias)


def score_texts(chain: Chain, texts: list) -> np.ndarray:
    """Probabilities (text x category)."""
    offsets, cols = columns(texts)
    out = np.zeros((len(texts), len(chain.names)))
    for c in range(len(chain.names)):
        sums = np.concatenate([[0.0], np.cumsum(chain.words[c][cols], dtype=np.float64)])
        out[:, c] = sigmoid(sums[offsets[1:]] - sums[offsets[:-1]] + out[:, :c] @ chain.earlier[c, :c] + chain.bias[c])
    return out


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """A chain fitted on at most ``rows`` labelled documents. Rows without a label or id are no training rows."""
    return fit_chain(training_rows(documents, labels, rows, id_col, text_col, label_col))


def score_documents(df: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """Adds one probability per category (``p_theme_1`` .. ``p_toxic``) to every row; whole texts, narrow.

    Null and empty texts score the bias alone; a very long text is scored whole. Rows that repeat, and null ids, are scored
    like others. Columns of the new names are replaced. An empty table gives an empty result.
    """
    names = [f"{prefix}{n}" for n in chain.names]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    model = df.sparkSession.sparkContext.broadcast(chain)
    schema = "struct<" + ", ".join(f"{n}: double" for n in names) + ">"

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(score_texts(model.value, texts.tolist()), columns=names)

    scored = df.withColumn("__scores", score(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__scores.{n}").alias(n) for n in names])


def is_toxic(scored: DataFrame, prefix: str = "p_", threshold: float = THRESHOLD) -> F.Column:
    """Whether any category of the chain reaches the threshold."""
    return F.greatest(*[F.col(f"{prefix}{n}") for n in (*(f"theme_{t + 1}" for t in range(THEMES)), "toxic")]) >= threshold
