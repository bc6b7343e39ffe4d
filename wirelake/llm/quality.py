"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Labelled documents give statistics, binned at quantiles; trees grow level by level from
histograms of gradients, all in numpy on the driver, from a bounded sample. The forest is a few
flat arrays, through which a batch of documents walks one level at a time, all trees at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .labelled import fold, training_rows

#: Labelled rows that the forest may learn from.
MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 80, 4, 48, 0.15, 12, 1.0

NAMES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "lower", "digit", "newline", "beyond_ascii",
    "stops", "odd_marks", "bars", "capitals_of_letters", "entropy", "distinct_words", "top_word", "same_as_before",
    "distinct_runs", "distinct_lines", "packs_to", "words_ending_oddly", "words_starting_upper",
)

_CLASS = np.zeros(256, np.int64)
for _name, _members in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", " \t\r\x0b\x0c", ".,;:?'\"-()", "!#$%&*@^~=+<>\\/[]{}_`", "|"), 1):
    for _c in _members.encode():
        _CLASS[_c] = _name
_CLASS[128:] = 9
_ODD = frozenset(b"!#$%&*@^~=+<>|")


def statistics(text: str) -> list[float]:
    """The features of one whole text, in the order of NAMES; zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 10) / n
    p = counts[counts > 0] / n
    words = raw.split()
    m = max(len(words), 1)
    codes = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    distinct, times = np.unique(codes, return_counts=True)
    runs = codes[:-3] * np.uint64(3) + codes[1:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[2:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[3:] if len(codes) > 3 else codes
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = kinds[1] + kinds[2]
    return [
        np.log1p(n), np.log1p(len(words)), (n - counts[32]) / m, np.log1p(max(map(len, words), default=0)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[9],
        kinds[6], kinds[7], kinds[8], kinds[1] / letters if letters else 0.0, float(-(p * np.log2(p)).sum()), len(distinct) / m, float(times.max()) / m if len(times) else 0.0,
        float((codes[1:] == codes[:-1]).sum()) / m, len(np.unique(runs)) / max(len(runs), 1), len(set(lines)) / max(len(lines), 1), len(zlib.compress(raw, 1)) / n,
        sum(w[-1] in _ODD for w in words) / m, sum(65 <= w[0] <= 90 for w in words) / m,
    ]


class Forest:
    """Boosted trees in flat arrays: node i of a tree sends x[feature] <= cut left, else right."""

    def __init__(self, base: float, feature=None, cut=None, left=None, right=None, value=None, roots=None):
        self.base, self.feature, self.cut, self.left, self.right, self.value, self.roots = base, feature, cut, left, right, value, roots

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, bins=BINS, rate=RATE, least=LEAST, l2=L2) -> Forest:
        """Learn from features ``x`` and labels ``y`` (0/1); a single class gives a constant."""
        if not len(y):
            return cls(0.0)
        prior = (y.sum() + 0.5) / (len(y) + 1.0)
        base = float(np.log(prior / (1 - prior)))
        if y.min() == y.max():
            return cls(base)
        rows, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
        slots = bins
        flat = binned + np.arange(width) * slots
        score = np.full(rows, base)
        feature, cut, left, right, value, roots = [], [], [], [], [], []

        def node() -> int:
            for a, v in ((feature, 0), (cut, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
                a.append(v)
            return len(left) - 1

        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            roots.append(node())
            here, open_ = np.zeros(rows, np.int64), {0: roots[-1]}  # place in the level, its nodes
            active = np.arange(rows)
            place = np.full(rows, roots[-1])
            for level in range(depth + 1):
                k = len(open_)
                gs, hs = (np.bincount(here[active], v[active], k) for v in (g, h))
                for j, i in open_.items():
                    value[i] = rate * gs[j] / (hs[j] + l2)
                if level == depth:
                    break
                at = (here[active, None] * (width * slots) + flat[active]).ravel()
                G, H, N = (np.bincount(at, np.repeat(v, width) if v is not None else None, k * width * slots).reshape(k, width, slots).cumsum(2) for v in (g[active], h[active], None))
                total_g, total_h, total_n = G[:, :, -1:], H[:, :, -1:], N[:, :, -1:]
                gain = G**2 / (H + l2) + (total_g - G) ** 2 / (total_h - H + l2) - total_g**2 / (total_h + l2)
                gain[(N < least) | (total_n - N < least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                nxt, mapping = {}, np.full((k, 2), -1)
                split_f, split_b = best // slots, best % slots
                for j, i in open_.items():
                    if gain.reshape(k, -1)[j, best[j]] > 1e-6:
                        feature[i], cut[i] = int(split_f[j]), float(edges[split_f[j]][split_b[j]])
                        left[i], right[i] = node(), node()
                        for side, c in enumerate((left[i], right[i])):
                            mapping[j, side] = len(nxt)
                            nxt[len(nxt)] = c
                if not nxt:
                    break
                side = (binned[active, split_f[here[active]]] > split_b[here[active]]).astype(int)
                to = mapping[here[active], side]
                active, to = active[to >= 0], to[to >= 0]
                here[active] = to
                place[active] = np.array([nxt[j] for j in range(len(nxt))])[to]
                open_ = nxt
            score += np.array(value)[place]
        return cls(base, np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        if self.roots is not None and len(x):
            rows, node = np.arange(len(x))[:, None], np.broadcast_to(self.roots, (len(x), len(self.roots)))
            while True:  # leaves lead to themselves
                nxt = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
                if (nxt == node).all():
                    break
                node = nxt
            total = total + self.value[node].sum(1)
        return 1 / (1 + np.exp(-total))


def features(rows: DataFrame, text_at: int) -> DataFrame:
    """``rows`` with the text column at ``text_at`` replaced by an array of statistics."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    kept = [f for i, f in enumerate(rows.schema.fields) if i != text_at]

    def run(batches):
        for batch in batches:
            x = [statistics(t or "") for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != text_at] + [pa.array(x, pa.list_(pa.float64()))], names=[f.name for f in kept] + ["x"])

    return rows.mapInArrow(tidy(run), StructType([*kept, StructField("x", ArrayType(DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest from at most ``most`` labelled documents outside the held-out fold."""
    sample = training_rows(docs, labels, label, folds, held_out, most, id_col, text_col)
    got: pd.DataFrame = features(sample, 1).toPandas().sort_values("__id", kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(NAMES))
    return Forest.fit(x, got["__label"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, threshold: float = 0.3, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (score >= threshold).

    Statistics of whole texts only; ids, labels, sources and languages are no inputs. Null and
    empty texts have all-zero statistics and the score those get. Without labels every score is
    0.5, with a single class the smoothed share of it. Repeated rows score alike; an empty table
    gives an empty result; other columns are ignored.
    """
    forest = train(docs, labels, label, folds, held_out, most, id_col, text_col)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(2).to_pylist()], np.float64).reshape(-1, len(NAMES))
            s = np.concatenate([forest.score(x[i : i + 1024]) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias(id_col), (fold(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, in one pass over them."""
    forest = train(docs, labels, id_col=id_col, text_col=text_col, **{k: v for k, v in params.items() if k != "threshold"})
    threshold, where = params.get("threshold", 0.3), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(where).to_pylist()], np.float64).reshape(-1, len(NAMES))
            if len(x):
                yield batch.filter(pa.array(np.concatenate([forest.score(x[i : i + 1024]) for i in range(0, len(x), 1024)]) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
