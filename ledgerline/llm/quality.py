"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from the bytes of whole texts. The trees are grown on quantile
bins with logistic loss, on at most `train_rows` labelled rows (smallest hashes of their
ids first), and flattened into arrays of complete binary trees that numpy walks for all
rows of a batch at once. Labels, lang, source and doc_id are no inputs of a score.

Results in odd cases: a null or empty text has all-zero statistics and a score as any
other; rows whose crc32(doc_id) mod 3 is 1 are never learnt from; a null doc_id counts as
learnable but has no label; conflicting labels of a doc_id all count, and of texts that
share a doc_id the least is learnt from; with no usable
label or one class only the score is the smoothed share of label 1; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textops as tx
from ledgerline.llm.common import table

TRAIN_ROWS = 20_000
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
RIDGE = 1.0
LEAST_WEIGHT = 2.0

#: Classes of bytes whose shares are statistics.
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "blank": " \t", "line": "\n", "stop": ".", "comma": ",", "bang": "!?", "bar": "|", "mark": "#$%&*", "quote": "\"'", "bracket": "()[]{}<>", "slash": "/\\:;=_-+@~^`"}
NAMES = ("bytes", *CLASSES, "high", "words", "word_bytes", "longest", "distinct", "commonest", "again", "line_distinct", "line_commonest")


def statistics(column) -> np.ndarray:
    """One row of NAMES per text of an Arrow column."""
    data, off = tx.text_bytes(column)
    out = np.zeros((len(off) - 1, len(NAMES)), np.float32)
    kinds = np.full(256, len(CLASSES) + 1, np.int64)
    kinds[128:] = len(CLASSES)
    for i, chars in enumerate(CLASSES.values()):
        kinds[[ord(c) for c in chars]] = i
    gap, line_gap = tx.gaps(" \t\n\x0b\x0c\r"), tx.gaps("\n")
    for a, b, part, at in tx.pieces(data, off):
        size = np.diff(at)
        of = np.repeat(np.arange(b - a), size)
        shares = np.bincount(of * (len(CLASSES) + 2) + kinds[part], minlength=(b - a) * (len(CLASSES) + 2)).reshape(b - a, -1)
        out[a:b, 0] = np.log1p(size)
        out[a:b, 1 : len(CLASSES) + 2] = shares[:, :-1] / np.maximum(size, 1)[:, None]
        sums = tx.prefix(part)
        start, end, first = tx.words(part, at, gap)
        hashes, long = tx.span(sums, start, end), end - start
        ls, le, lf = tx.words(part, at, line_gap)
        lines = tx.span(sums, ls, le)
        i = 2 + len(CLASSES)
        for row in range(b - a):
            x, y = first[row], first[row + 1]
            if y > x:
                own = hashes[x:y]
                _, n = np.unique(own, return_counts=True)
                out[a + row, i : i + 6] = np.log1p(y - x), long[x:y].mean(), np.log1p(long[x:y].max()), len(n) / (y - x), n.max() / (y - x), (own[1:] == own[:-1]).mean() if y - x > 1 else 0
                _, n = np.unique(lines[lf[row] : lf[row + 1]], return_counts=True)
                out[a + row, i + 6 : i + 8] = len(n) / n.sum(), n.max() / n.sum()
    return out


@dataclass
class Trees:
    """Complete binary trees in level order: feature and cut of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            raw += leaf[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost `trees` trees of `depth` levels on the quantile bins of x."""
    mean = (y.sum() + 1) / (len(y) + 2)
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            slot = node - first
            best = np.full(width, 1e-6)
            place = np.full((width, 2), -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = slot * bins + binned[:, f]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                gain = g**2 / (h + RIDGE) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + RIDGE) - (g[:, -1:] ** 2 / (h[:, -1:] + RIDGE))
                gain[(h < LEAST_WEIGHT) | (h[:, -1:] - h < LEAST_WEIGHT)] = 0
                gain[:, len(e) :] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                place[better] = np.stack([np.full(better.sum(), f), at[better]], axis=1)
            for s in np.flatnonzero(place[:, 0] >= 0):
                out.feature[t, first + s], out.cut[t, first + s] = place[s, 0], edges[place[s, 0]][place[s, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.cut[t, node])
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        out.leaf[t] = rate * g / (h + RIDGE)
        raw += out.leaf[t][node - inner]
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measured(batches):
    for batch in batches:
        rows = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(list(rows), pa.list_(pa.float32()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most train_rows labels; ids, labels and statistics of those reach the driver."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    marks = usable.select(F.col(id_col).cast("long").alias("doc"), F.col(label).cast("int").alias("mark"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    chosen = marks.distinct().orderBy(F.xxhash64("doc"), "doc", "mark").limit(train_rows)
    # one text for each label, so the bound holds whatever ids repeat
    rows = texts.join(F.broadcast(chosen), "doc").groupBy("doc", "mark").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc", "text", "mark")
    found = rows.mapInArrow(tx.trimmed(_measured), "doc_id long, label int, x array<float>").collect()
    found.sort(key=lambda r: (r.doc_id, r.label, list(r.x)))
    return fit(np.array([r.x for r in found], np.float32).reshape(-1, len(NAMES)), np.array([r.label for r in found], np.float64))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""

    def run(batches):
        for batch in batches:
            s = trees.score(statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(tx.trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
