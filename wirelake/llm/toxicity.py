"""Toxicity: embeddings of subword bags, averaged over a document into a linear softmax.

A word is the bag of its character n-grams and itself, hashed to buckets; a document's vector is
the mean over its words of their bags' mean embeddings. Embeddings and softmax are trained jointly
in numpy from a bounded labelled sample. Both steps after the embedding are linear, so at scoring
time each bucket needs one number, its embedding times the softmax's weight difference, and each
distinct word is looked up once; a misspelling scores by the n-grams it still shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .arrays import tidy
from .labelled import fold, training_rows

#: Labelled documents that the model may learn from.
MOST_ROWS = 12_000
BUCKETS, WIDTH, EPOCHS, BATCH, RATE = 1 << 17, 8, 60, 64, 0.5
#: Steps after which training ends, or after ``EPOCHS``: larger samples need fewer rounds.
STEPS = 2_850
#: Every bucket of the sample gets an embedding. Its shares are shrunk, smoothly and never to nothing
#: where it tells labels apart at all: to a half at so many standard errors. One more document in
#: the variance makes rare buckets count less; unshrunk, they would just be memorised.
ERRORS = 5.0
#: Bytes, about, of the words whose scores a worker remembers.
CACHE = 48 << 20
#: Pieces in which the driver fetches the sample's bags.
PARTS = 12
_TRIM = ".,;:!?\"'()[]{}<>|#$%&*…«»-_"


def subwords(tokens: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) arrays: for each token its whole form and its n-grams of 3 to 5 characters."""
    words = [f"<{t.lower().strip(_TRIM) or t}>" for t in tokens]
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths) - lengths
    odd = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(codes)) - first[word]
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((codes + (place.astype(np.uint64) << np.uint64(21))) * odd ^ ((codes * place.astype(np.uint64)) << np.uint64(7)), first) if len(words) else codes
        owners, hashes = [np.arange(len(words))], [whole * odd]
        rolling = codes.copy()
        for n in range(2, 6):
            rolling = rolling[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n > 2:
                inside = (word[: len(rolling)] == word[n - 1 :]) & (lengths[word[: len(rolling)]] > n)
                owners.append(word[: len(rolling)][inside])
                hashes.append(rolling[inside] * odd)
        return np.concatenate(owners), (np.concatenate(hashes) >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)


def bags_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each whole text the distinct buckets and their shares in its mean."""
    out = []
    for text in texts:
        counts: dict[str, int] = {}
        for w in text.split():
            counts[w] = counts.get(w, 0) + 1
        owner, bucket = subwords(list(counts))
        size = np.bincount(owner, minlength=len(counts))
        share = np.array(list(counts.values()), np.float64) / max(sum(counts.values()), 1) / np.maximum(size, 1)
        ids, back = np.unique(bucket, return_inverse=True)
        out.append((ids.astype(np.int32), np.bincount(back, share[owner], len(ids)).astype(np.float32)))
    return out


def trust(held: np.ndarray, positive: np.ndarray, rows: int, positives: int) -> np.ndarray:
    """How far each bucket's share counts, 0 to 1, by how many documents (of label 1) hold it."""
    p = positives / max(rows, 1)
    errors = np.abs(positive - held * p) / np.sqrt(held * p * (1 - p) + 1)
    return (errors**4 / (errors**4 + ERRORS**4)).astype(np.float32)


class SubwordModel:
    """``weight[b]``: what bucket b adds to the log odds of label 1; ``bias``: for no words."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias
        self._known: dict[str, float] = {}
        self._held = 0

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias, "_known": {}, "_held": 0}

    @classmethod
    def fit(cls, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width=WIDTH, epochs=EPOCHS, batch=BATCH, rate=RATE, seed=3) -> SubwordModel:
        """Joint training by AdaGrad; no rows or a single class give a constant."""
        p = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
        bias = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(BUCKETS, np.float32), bias)
        rng = np.random.default_rng(seed)
        present = np.zeros(BUCKETS, bool)
        for ids, _ in bags:
            present[ids] = True
        used, spot = np.flatnonzero(present), (np.cumsum(present) - 1).astype(np.int32)
        if not len(used):
            return cls(np.zeros(BUCKETS, np.float32), bias)
        E = np.ascontiguousarray(rng.normal(0, 0.1, (len(used), width)).T.astype(np.float32))  # a row per dimension
        U = rng.normal(0, 0.1, (width, 2)).astype(np.float32)
        b = np.array([0.0, bias], np.float32)
        E2, U2, b2 = np.full(E.shape, 1e-8, np.float32), np.full(U.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
        spots = [spot[ids] for ids, _ in bags]
        held = np.array([len(s) for s in spots], np.int64)
        move = np.empty(len(used), np.float32)
        epochs = min(epochs, -(-STEPS // -(-len(y) // batch)))
        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                sizes = held[rows]
                v = U[:, 1] - U[:, 0]
                z = np.full(len(rows), b[1] - b[0], np.float32)
                if sizes.any():
                    i, share = np.concatenate([spots[r] for r in rows]), np.concatenate([bags[r][1] for r in rows])
                    full = np.flatnonzero(sizes)
                    z[full] += np.add.reduceat(share * (v @ E)[i], (np.cumsum(sizes) - sizes)[full])
                d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[rows]).astype(np.float32)
                if sizes.any():
                    # with two classes every gradient is a multiple of one number per bucket
                    g = np.bincount(i, share * np.repeat(d, sizes), len(used)).astype(np.float32)
                    gU = (E @ g)[:, None] * np.array([-1, 1], np.float32)
                    squares = g * g
                    for k in range(width):  # buckets that no row holds stay: their gradient is 0
                        np.multiply(squares, v[k] * v[k], out=move)
                        E2[k] += move
                        np.sqrt(E2[k], out=move)
                        np.divide(g, move, out=move)
                        move *= step * v[k]
                        E[k] -= move
                    U2 += gU**2
                    U -= step * gU / np.sqrt(U2)
                gb = np.array([-d.sum(), d.sum()], np.float32)
                b2 += gb**2
                b -= np.float32(0.1) * step * gb / np.sqrt(b2)
        weight = np.zeros(BUCKETS, np.float32)
        weight[used] = (U[:, 1] - U[:, 0]) @ E
        return cls(weight, float(b[1] - b[0]))

    def score(self, text: str) -> float:
        """Probability of label 1 for a whole text."""
        words = text.split()
        known = self._known
        new = list(set(words).difference(known))
        self._held += sum(map(len, new)) * 2 + 160 * len(new)
        if self._held > CACHE:
            known.clear()
            new = list(set(words))
            self._held = 0
        if new:
            owner, bucket = subwords(new)
            mean = np.bincount(owner, self.weight[bucket], len(new)) / np.bincount(owner, minlength=len(new))
            known.update(zip(new, mean.tolist(), strict=True))
        z = self.bias + (sum(map(known.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """A model from at most ``most`` labelled documents outside the held-out fold; executors send
    bags of bucket shares, not texts."""

    sample = materialise(training_rows(docs, labels, label, folds, held_out, most, id_col, text_col), "toxic-sample")

    def count(batches):
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            y = batch.column(2).to_pylist()
            for (ids, _), one in zip(bags_of([t or "" for t in batch.column(1).to_pylist()]), y, strict=True):
                held[int(one > 0), ids] += 1
        ids = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(held[:, ids].sum(0)), pa.array(held[1, ids])], names=["bucket", "held", "positive"])

    seen = sample.mapInArrow(tidy(count), "bucket bigint, held bigint, positive bigint").groupBy("bucket").agg(F.sum("held"), F.sum("positive")).toArrow()  # at most BUCKETS rows
    held, positive = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = np.asarray(seen.column(0))
    held[at], positive[at] = np.asarray(seen.column(1)), np.asarray(seen.column(2))
    totals = sample.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0))).first()
    scale = trust(held, positive, *totals)

    def run(batches):
        for batch in batches:
            bags = [(b, v * scale[b]) for b, v in bags_of([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b for b, _ in bags], pa.list_(pa.int32())), pa.array([s for _, s in bags], pa.list_(pa.float32()))], names=["id", "label", "buckets", "shares"])

    bags, y = [], []
    for part in range(PARTS):  # the driver's JVM holds one part at a time
        mine = sample.filter(F.pmod(F.xxhash64("__id"), F.lit(PARTS)) == part)
        got = mine.mapInArrow(tidy(run), f"id {sample.schema[0].dataType.simpleString()}, label int, buckets array<int>, shares array<float>").toArrow().sort_by("id")
        bags += [(np.asarray(b.values), np.asarray(v.values)) for b, v in zip(got.column("buckets"), got.column("shares"), strict=True)]
        y += got.column("label").to_pylist()
    release(docs.sparkSession, sample)
    model = SubwordModel.fit(bags, np.asarray(y, np.float64))
    model.weight = model.weight * scale
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, threshold: float = 0.3, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (score >= threshold).

    Words of whole texts are the only input. Null, empty and blank texts score by the bias alone.
    Without labels every score is 0.5, with a single class the smoothed share of it. Repeated rows
    score alike; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, labels, label, folds, held_out, most, id_col, text_col)

    def run(batches):
        for batch in batches:
            s = np.array([model.score(t or "") for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias(id_col), (fold(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
