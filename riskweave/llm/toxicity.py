"""Toxicity by a chain of linear classifiers.

The categories are predicted in a fixed order by logistic models over the words
of a text and their first bytes (4, 5 and 6 of them, so that stems count where
endings vary). The model of a category also sees the log-odds that the models
before it gave. In training these come from models that didn't see the row
(out-of-fold), so that a later model learns how far to trust an earlier one; in
use, from the models trained on all training rows.

The models are fitted on a bounded sample of the labelled rows, the least by a
hash of doc_id in each combination of labels, ROWS at most of each, weighted
back to the share that the combination has among all labels. A model is sparse
by design: of the features of its training rows it has those that at least
LEAST_ROWS rows have and that tell the category apart with a z-score over
LEAST_Z, and the FEATURES best of these. These four bounds are parameters of
the fit alone; every document is scored, by its whole text.

The labels at hand have two columns, so the chain is ``low_quality`` and then
``toxic``; ``CATEGORIES`` takes any number.

Defined cases: a text that is null or has no words is scored by the intercepts;
labels with a null in any category, or whose doc_id is null or not among the
documents, aren't used; a doc_id labelled twice counts with its largest label;
of labelled rows that repeat a doc_id the text of the least hash is learnt from;
without labels, or where a category has one value only, the probability is that
value's share, but at most 0.499, so that no text is rejected on its account
(0 without any label);
repeated rows are scored each; an empty table gives no rows; extra columns are
ignored, and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded, ship
from ._text import Words, chunked

#: Category and how the labels give it, in the order of the chain.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))
ROWS = 1500
FEATURES = 6000
LEAST_Z, LEAST_ROWS = 3.0, 3
FOLDS = 5
PENALTY = 1e-3
THRESHOLD = 0.5
_STEMS = (4, 5, 6)
_SALT = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], np.uint64)
_U = np.uint64


def features(words: Words) -> np.ndarray:
    """Feature hashes of each word: one row for whole words and one for each stem length."""
    return np.stack([words.hash, *[words.prefix_hash(n) ^ s for n, s in zip(_STEMS, _SALT[1:])]])


class Linear:
    """A logistic model over present features and the log-odds of earlier models."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    @staticmethod
    def fit(rows: np.ndarray, index: np.ndarray, own: np.ndarray, n: int, y: np.ndarray, sample_weight: np.ndarray, earlier: np.ndarray, penalty: float = PENALTY) -> Linear:
        """rows, index: the present features as places in own (sorted hashes), each once a row; earlier: n x k log-odds."""
        k = earlier.shape[1]
        w = sample_weight / sample_weight.sum()
        rate = float((w * y).sum())
        if n == 0 or y.min() == y.max():
            p = min(max(rate if n else 0.0, 1e-6), 0.499)
            return Linear(np.zeros(0, _U), np.zeros(k), float(np.log(p / (1 - p))))
        pos = np.bincount(index, weights=y[rows], minlength=len(own))
        all_ = np.bincount(index, minlength=len(own))
        n1, n0 = y.sum(), n - y.sum()
        p = all_ / n
        z = np.abs(pos / n1 - (all_ - pos) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        order = np.argsort(-z, kind="stable")[:FEATURES]
        chosen = np.sort(order[(z[order] > LEAST_Z) & (all_[order] >= LEAST_ROWS)])
        place = np.full(len(own), -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        use = place[index] >= 0
        r, c = rows[use].astype(np.int64), place[index[use]].astype(np.int64)  # as bincount takes them, not cast in each step
        m = len(chosen)
        dot = lambda v: np.bincount(r, weights=v[c], minlength=n) + earlier @ v[m : m + k] + v[-1]
        back = lambda g: np.concatenate([np.bincount(c, weights=g[r], minlength=m), earlier.T @ g, [g.sum()]])
        v = np.ones(m + k + 1)
        for _ in range(12):  # the largest curvature, by power iteration
            v = back(w * dot(v))
            size = np.linalg.norm(v)
            v /= size
        step = 1 / (0.25 * size * 1.1 + penalty)
        reg = np.full(m + k + 1, penalty)
        reg[-1] = 0
        x = np.zeros(m + k + 1)
        x[-1] = np.log(rate / (1 - rate))
        ahead, t = x.copy(), 1.0
        for _ in range(400):
            g = back(w * (1 / (1 + np.exp(-dot(ahead))) - y)) + reg * ahead
            new = ahead - step * g
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, moved = new + (t - 1) / t2 * (new - x), np.abs(new - x).max()
            x, t = new, t2
            if moved < 1e-5:
                break
        return Linear(own[chosen], x[:-1], float(x[-1]))

    def odds(self, rows: np.ndarray, hashes: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        m = len(self.hashes)
        out = np.full(n, self.bias) + earlier @ self.weights[m:]
        if m and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), m - 1)
            hit = self.hashes[at] == hashes
            out += np.bincount(rows[hit], weights=self.weights[at[hit]], minlength=n)
        return out


def fit_chain(rows: np.ndarray, hashes: np.ndarray, n: int, labels: np.ndarray, weight: np.ndarray) -> list[Linear]:
    """labels: n x categories. Each model's earlier log-odds are out-of-fold."""
    fold, chain, earlier = np.arange(n) % FOLDS, [], np.zeros((n, 0))
    own, index = np.unique(hashes, return_inverse=True)
    index = index.astype(np.int32)
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        chain.append(Linear.fit(rows, index, own, n, y, weight, earlier))
        if j < labels.shape[1] - 1:
            odds = np.zeros(n)
            for f in range(FOLDS):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if not len(train) or not len(test):
                    odds[test] = chain[-1].bias
                    continue
                to = np.full(n, -1, np.int32)
                to[train] = np.arange(len(train), dtype=np.int32)
                use = to[rows] >= 0
                model = Linear.fit(to[rows[use]], index[use], own, len(train), y[train], weight[train], earlier[train])
                to = np.full(n, -1, np.int32)
                to[test] = np.arange(len(test), dtype=np.int32)
                use = to[rows] >= 0
                odds[test] = model.odds(to[rows[use]], hashes[use], len(test), earlier[test])
            earlier = np.column_stack([earlier, odds])
    return chain


def predict_chain(chain: list[Linear], rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x categories probabilities."""
    earlier = np.zeros((n, 0))
    for model in chain:
        earlier = np.column_stack([earlier, model.odds(rows, hashes, n, earlier)])
    return 1 / (1 + np.exp(-np.clip(earlier, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, rows: int = ROWS) -> list[Linear]:
    ship(docs.sparkSession)
    names = [c for c, _ in categories]
    values = [F.expr(e).cast("int").alias(c) for c, e in categories]
    known = labels.select("doc_id", *values).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # a label without its document mustn't use up the bound
    mark = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    picked = known.withColumn("_place", F.row_number().over(Window.partitionBy(*names).orderBy(mark, "doc_id"))).where(F.col("_place") <= rows)
    share = known.groupBy(*names).agg(F.count("*").alias("_all"))
    picked = picked.join(share, names).withColumn("_weight", F.col("_all") / F.least(F.col("_all"), F.lit(rows))).drop("_place", "_all")
    picked = bounded(picked)  # so that the join leaves the documents where they are

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            words = Words(batch.column("text"))
            h = features(words)
            own = [np.unique(h[:, a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *names, "_weight")], pa.array(own, pa.binary())], names=["doc_id", *names, "_weight", "h"])

    rows_ = docs.select("doc_id", F.lower("text").alias("text")).join(picked, "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows_ = rows_.withColumn("_first", first).where("_first = 1").drop("_first")
    found = rows_.mapInArrow(write, picked.select("doc_id", *names, "_weight").schema.add("h", "binary")).toArrow().sort_by("doc_id")
    sets = [np.frombuffer(x, _U) for x in found.column("h").to_pylist()]
    n = len(sets)
    y = np.stack([found.column(c).to_numpy() for c in names], 1).astype(float) if n else np.zeros((0, len(names)))
    hashes = np.concatenate(sets) if n else np.zeros(0, _U)
    return fit_chain(np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets]) if n else np.zeros(0, np.int32), hashes, n, y, found.column("_weight").to_numpy().astype(float) if n else np.zeros(0))


def _scored(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...], columns: list[str]) -> DataFrame:
    """The given columns (plain names) with p_<category>; ``docs`` has the lower-cased text as ``_text``."""
    chain = train(docs, labels, categories)
    known = np.unique(np.concatenate([m.hashes for m in chain]))
    seen = np.zeros(1 << 20, bool)
    seen[known >> _U(44)] = True
    scores = [f"p_{c}" for c, _ in categories]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            words = Words(batch.column("_text"))
            doc, h = words.doc, features(words)
            rows, hashes = [], []
            for line in h:
                maybe = np.flatnonzero(seen[line >> _U(44)])
                x = line[maybe]
                hit = known[np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))] == x if len(known) else np.zeros(len(x), bool)
                rows.append(doc[maybe[hit]])
                hashes.append(x[hit])
            r, x = np.concatenate(rows), np.concatenate(hashes)
            o = np.lexsort((x, r))
            r, x = r[o], x[o]
            new = np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])) if len(r) else np.zeros(0, bool)
            p = predict_chain(chain, r[new], x[new], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], *[pa.array(p[:, j]) for j in range(len(scores))]], names=[*columns, *scores])

    schema = docs.select(*columns).schema
    for c in scores:
        schema = schema.add(c, "double")
    return docs.select(*columns, "_text").mapInArrow(write, schema)


def score(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category, and whether the last one rejects the document."""
    rows = _scored(docs.select("doc_id", "text", F.lower("text").alias("_text")), labels, categories, ["doc_id"])
    return rows.withColumn("rejected", F.col(f"p_{categories[-1][0]}") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't rejected."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    ident, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names).withColumns({"doc_id": F.col(ident), "text": F.col(text), "_text": F.lower(text)})
    rows = _scored(plain, labels, categories, names)
    return rows.where(F.col(f"p_{categories[-1][0]}") < threshold).select(*names).toDF(*docs.columns)
