"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

Counting: every training token is counted, partial counts first, then by token over a shuffle.

Model: P(token | before) = P(class | context) * P(token | rest, cluster). The ``CLASSES`` most
frequent tokens are classes of their own, all others make one. The context is the token before or,
after a token of the rest, the cluster of the last frequent token with a mark. Both factors are
log-bilinear, products of vectors plus a bias, and trained on the noise-contrastive objective, whose
expectation over the noise has a closed form in the counts:

* class and context vectors from counts of pairs over all training documents, in numpy on a
  matrix whose size no corpus changes; frequent tokens with like vectors form ``CLUSTERS``;
* a vector for every other token, however many the corpus has. Given the clusters' vectors, the
  objective falls apart by token, so tasks fit batches of tokens side by side.

Scoring: one product of the vector tables, normalised by rows, gives every class's log-probability;
a sum over all tokens of the rest, a number per cluster, normalises theirs.

Counts and fits of at most ``KNOWN`` of the most frequent tokens go to the workers; the rare rest of
each document meets them in a join, where no token can be frequent enough to be a hot key.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import tidy
from .labelled import fold

#: Size of the model: tokens with a class of their own, clusters of them, dimensions of their vectors
#: and of those of other tokens.
CLASSES, CLUSTERS, WIDTH, NARROW = 2048, 16, 32, 8
#: Tokens whose figures travel with the tasks, and the bytes that each may have: 8 MB in all. Longer
#: ones are served by a join, as rare ones are.
KNOWN, LONGEST = 1 << 17, 64
STEPS, RATE, NOISE = 90, 0.05, 10.0
#: Steps for a token of the rest, and the weight that keeps its vector short.
REST_STEPS, SHORT = 20, 1.0
#: Entries of a partial count, and bytes of text, before it is handed on.
PARTIAL, PARTIAL_BYTES = 300_000, 1 << 25
END = b""


def tokens(text: str) -> list[bytes]:
    """Words of a whole text with A-Z lower-cased; the end token is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class _Ids(dict):
    def __missing__(self, token):
        return -1


class LogBilinear:
    """log10 P(class | context): ``table[context, class]``; ``contexts``: their vectors."""

    def __init__(self, table: np.ndarray, contexts: np.ndarray):
        self.table, self.contexts = table, contexts

    @classmethod
    def fit(cls, bigrams: np.ndarray, width=WIDTH, steps=STEPS, rate=RATE, noise=NOISE, seed=11) -> LogBilinear:
        """Learn from a matrix of pair counts, contexts by classes, by gradient steps on the
        noise-contrastive objective, with the smoothed class frequencies as noise."""
        n = np.asarray(bigrams, np.float32)
        size = n.shape[1]
        total = max(float(n.sum()), 1.0)
        p = ((n.sum(0) + 0.5) / (float(n.sum()) + 0.5 * size)).astype(np.float32)
        rng = np.random.default_rng(seed)
        params = [rng.normal(0, 0.1, (len(n), width)).astype(np.float32), rng.normal(0, 0.1, (size, width)).astype(np.float32), np.log(p)]
        moments = [(np.zeros_like(v), np.zeros_like(v)) for v in params]
        weight = n.sum(1, keepdims=True) * (noise * p)[None]
        offset = np.log(noise * p)[None]
        for t in range(1, steps + 1):
            q, r, b = params
            s = q @ r.T
            s += b - offset
            np.clip(s, -30, 30, out=s)
            np.exp(-s, out=s)
            s += 1
            np.reciprocal(s, out=s)  # probability that a token comes from the text, not the noise
            g = n - (n + weight) * s
            g *= size / total
            for k, grad in enumerate((g @ r, g.T @ q, g.sum(0))):
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                params[k] = params[k] + rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        q, r, b = params
        s = (q @ r.T + b).astype(np.float64)
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        return cls((s / np.log(10)).astype(np.float32), q)


def clusters_of(vectors: np.ndarray, weight: np.ndarray, count: int = CLUSTERS, seed: int = 13) -> np.ndarray:
    """Cluster of each row, by weighted k-means from seeded, far starts."""
    rng, count = np.random.default_rng(seed), min(count, len(vectors))
    centre = vectors[[int(np.argmax(weight))]]
    while len(centre) < count:
        away = ((vectors[:, None] - centre[None]) ** 2).sum(2).min(1) * weight
        pick = rng.choice(len(vectors), p=away / away.sum()) if away.sum() > 0 else rng.integers(len(vectors))
        centre = np.vstack([centre, vectors[pick]])
    for _ in range(15):
        mine = ((vectors[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for g in range(count):
            if weight[mine == g].sum() > 0:
                centre[g] = np.average(vectors[mine == g], axis=0, weights=weight[mine == g])
    return ((vectors[:, None] - centre[None]) ** 2).sum(2).argmin(1)


def fit_tokens(n: np.ndarray, totals: np.ndarray, p: np.ndarray, directions: np.ndarray, steps=REST_STEPS, noise=NOISE, short=SHORT) -> np.ndarray:
    """Log weights (tokens by clusters), product of a vector of each token and the clusters'
    ``directions`` plus a bias, that fit counts ``n`` of tokens after clusters (of ``totals`` tokens
    of the rest). Steps along the gradient of the noise-contrastive objective, each parameter's
    divided by a bound on its curvature that includes what the others add; no step moves a log weight
    by more than 1, over which the curvature changes little, so no count makes it diverge."""
    d = np.hstack([directions, np.ones((len(directions), 1))])  # the bias is a vector's last number
    bound = np.abs(d) * np.abs(d).sum(1, keepdims=True)
    keep = np.append(np.full(directions.shape[1], short), 0.0)
    r = np.zeros((len(n), d.shape[1]))
    r[:, -1] = np.log(p)
    offset, wide = np.log(noise * p)[:, None], noise * p[:, None] * totals[None]
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(r @ d.T - offset, -30, 30)))
        slope, bend = n - (n + wide) * s, (n + wide) * s * (1 - s)
        move = (slope @ d - keep * r) / (bend @ bound + keep + 1e-9)
        r += move / np.maximum(np.abs(move @ d.T).max(1, keepdims=True), 1)
    return r @ d.T


@dataclass
class LanguageModel:
    """``words`` known, classes first; ``table[context, class]``; ``cluster`` of each class; ``rest``:
    (token, c, fit) of all training tokens that are no class, ``fit`` and ``unseen`` in log10 by cluster."""

    words: list[bytes]
    counts: np.ndarray
    classes: int
    total: int
    distinct: int
    table: np.ndarray
    cluster: np.ndarray
    rest: DataFrame
    unseen: np.ndarray


def contexts(i: np.ndarray, classes: int, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, cluster) at each place of a text of class numbers, ``classes`` for the rest."""
    before = np.append(0, i[:-1])  # a text begins as after an end
    rest = before == classes
    last = before[np.maximum.accumulate(np.where(rest, 0, np.arange(len(before))))]
    return np.where(rest, classes + cluster[last], before), cluster[last]


def _class_numbers(w: list[bytes], ids: _Ids, classes: int) -> np.ndarray:
    i = np.zeros(len(w) + 1, np.int64)
    i[:-1] = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
    i[(i < 0) | (i >= classes)] = classes
    return i


def token_totals(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of (id, text), the end token of each text among them."""

    def run(batches):
        counts, size = Counter(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts.update(tokens(text))
                size += len(text)
                if len(counts) > PARTIAL or size > PARTIAL_BYTES:
                    yield out()
                    counts.clear()
                    size = 0
            counts[END] += batch.num_rows
        yield out()

    return texts.mapInArrow(tidy(run), "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c")).filter("c > 0")


def pair_counts(texts: DataFrame, known: list[bytes], classes: int, cluster: np.ndarray, groups: int, with_rest: bool = True) -> tuple[np.ndarray, DataFrame]:
    """Counts of (context, class) over all rows, and (token, n): how often each token of the rest
    comes after each cluster, an array."""
    width = classes + 1
    size = (classes + groups) * width
    mark = [bytes([g]) for g in range(groups)]

    def run(batches):
        ids = _Ids((w, i) for i, w in enumerate(known[:classes]))
        total, counts, seen = np.zeros(size, np.int64), Counter(), 0
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64())

        def rows(pair, token, g, n):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((pair, token, g, n), kinds, strict=True)], names=["pair", "token", "g", "n"])

        def out():
            return rows([None] * len(counts), [t[:-1] for t in counts], [t[-1] for t in counts], list(counts.values()))

        for batch in batches:
            for text in batch.column(1).to_pylist():
                w = tokens(text)
                i = _class_numbers(w, ids, classes)
                context, g = contexts(i, classes, cluster)
                np.add.at(total, context * width + i, 1)
                rest = np.flatnonzero(i == classes) if with_rest else i[:0]
                counts.update([w[j] + mark[k] for j, k in zip(rest.tolist(), g[rest].tolist(), strict=True)])
                seen += len(text)
                if len(counts) > PARTIAL or seen > PARTIAL_BYTES:
                    yield out()
                    counts.clear()
                    seen = 0
        yield out()
        at = np.flatnonzero(total)
        for k in range(0, len(at), 200_000):
            part = at[k : k + 200_000]
            yield rows(part, [None] * len(part), [None] * len(part), total[part])

    found = materialise(texts.mapInArrow(tidy(run), "pair bigint, token binary, g int, n bigint"), "lm-pairs")
    got = found.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    pairs = np.zeros(size, np.float32)
    pairs[np.asarray(got.column("pair"))] = np.asarray(got.column("n"))
    by_cluster = [F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0)) for g in range(groups)]
    rest = found.filter("token is not null").groupBy("token").agg(F.array(*by_cluster).alias("n"))
    return pairs.reshape(classes + groups, width), rest


def train(texts: DataFrame, classes: int = CLASSES, known: int = KNOWN, clusters: int = CLUSTERS) -> LanguageModel:
    """A model of all rows of (id, text)."""
    counts = materialise(token_totals(texts), "token-counts")
    N, V = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)  # tokens by size of count: no order over all of them
    tops, least = 0, None
    short = (F.col("token") != END) & (F.octet_length("token") <= LONGEST)
    for r in counts.filter(short).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundreds of rows
        if tops + r["count"] > known - 1:
            break
        tops, least = tops + r["count"], r.level
    top = counts.filter(short & (level >= least if least is not None else F.lit(False))).toArrow()
    order = sorted(zip((-c for c in top.column("c").to_pylist()), top.column("token").to_pylist(), strict=True))
    ends = counts.filter(F.col("token") == END).first()
    words, c = [END, *(t for _, t in order)], np.array([ends.c if ends else 0, *(-n for n, _ in order)], np.float64)
    classes = min(classes, len(words))
    plain, _ = pair_counts(texts, words, classes, np.zeros(classes, np.int64), 1, with_rest=False)
    first = LogBilinear.fit(plain)
    cluster = clusters_of(first.contexts[:classes].astype(np.float64), plain[:classes].sum(1) + 1e-3, clusters)
    groups = int(cluster.max()) + 1
    pairs, rest = pair_counts(texts, words, classes, cluster, groups)
    model = LogBilinear.fit(pairs)
    share = pairs[:classes].sum(1) + 1e-3
    centre = np.stack([np.average(model.contexts[:classes][cluster == g], axis=0, weights=share[cluster == g]) for g in range(groups)]).astype(np.float64)
    centre -= centre.mean(0)
    u, size, _ = np.linalg.svd(centre, full_matrices=False)
    directions = (u * size)[:, :NARROW] / max(float(size[0]), 1e-9) * groups**0.5
    totals = np.bincount(np.concatenate([cluster, np.arange(groups)]), pairs[:, classes], groups)
    rest_n = float(N - c[:classes].sum())
    rest_v = max(V - int((c[:classes] > 0).sum()), 0)
    places = rest_n + rest_v + 1

    def fit(batches):
        for batch in batches:
            n = np.asarray(batch.column(1).flatten()).astype(np.float64).reshape(-1, groups)
            mine = n.sum(1)
            s = fit_tokens(n, totals, (mine + 1) / places, directions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine.astype(np.int64)), pa.array(list(s), pa.list_(pa.float64()))], names=["token", "c", "fit"])

    fitted = materialise(rest.mapInArrow(tidy(fit), "token binary, c bigint, fit array<double>"), "lm-tokens")
    sums = fitted.agg(*(F.coalesce(F.sum(F.exp(F.col("fit")[g])), F.lit(0.0)) for g in range(groups))).first()
    norm = np.log(np.array(sums) + 1 / places)
    steady = F.zip_with("fit", F.array(*(F.lit(float(z)) for z in norm)), lambda s, z: (s - z) / F.lit(float(np.log(10))))
    return LanguageModel(words, c, classes, int(N), int(V), model.table, cluster, fitted.select("token", "c", steady.alias("fit")), (-np.log(places) - norm) / np.log(10))


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, classes: int = CLASSES, known: int = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    * Whole texts; null and empty ones are the end token alone. Tokens, ``base_score`` (add-one
      unigram) and ``score`` (the model) are in log10; both spread probability over all training
      tokens and one unseen token.
    * Documents outside the held-out fold are the training set; all of them are counted. Without
      any, N is 0, nothing is known, and scores are those of the untrained model.
    * Rows are scored one by one, those that repeat an id or have none as well; ids of any type. An
      empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold(F.col(id_col), folds) == held_out).alias("held_out"))
    model = train(texts.filter("not held_out").select("id", "text"), classes, known)
    classes, places, unseen = model.classes, model.total + model.distinct + 1, model.unseen
    within = np.zeros((len(model.words), len(unseen)), np.float32)
    at = {w: i for i, w in enumerate(model.words)}
    least = int(model.counts[classes:].min()) if len(model.words) > classes else None
    if least is not None:
        some = model.rest.filter((F.col("c") >= least) & (F.octet_length("token") <= LONGEST)).toArrow()  # the known ones, at most ``known`` rows
        where = np.array([at.get(t, -1) for t in some.column("token").to_pylist()])
        values = np.asarray(some.column("fit").combine_chunks().flatten()).reshape(len(where), -1)
        within[where[where >= 0]] = values[where >= 0]
    shared = spark.sparkContext.broadcast((model.words, np.log10((model.counts + 1) / places), within, model.counts > 0, model.table, model.cluster))

    def score(batches):
        words, base, within, seen, table, cluster = shared.value
        ids = _Ids((w, i) for i, w in enumerate(words))
        for batch in batches:
            n, k, b, s, rare = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                w = tokens(text)
                i = np.zeros(len(w) + 1, np.int64)
                i[:-1] = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
                cls = np.where((i < 0) | (i >= classes), classes, i)
                context, g = contexts(cls, classes, cluster)
                missing, known_ = np.flatnonzero(i < 0), np.flatnonzero(i >= classes)
                extra = Counter(zip([w[j] for j in missing.tolist()], g[missing].tolist(), strict=True))
                found = i[i >= 0] if len(missing) else i
                n.append(len(i))
                k.append(int(seen[found].sum()))
                b.append(float(base[found].sum()))
                s.append(float(table[context, cls].astype(np.float64).sum()) + float(within[i[known_], g[known_]].astype(np.float64).sum()))
                rare.append([{"token": t, "g": c, "n": m} for (t, c), m in extra.items()])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("token", pa.binary()), ("g", pa.int32()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(v, t) for v, t in zip((n, k, b, s, rare), kinds, strict=True))], names=["id", "held_out", "n_tokens", "k", "b", "s", "rare"])

    kind = texts.schema["id"].dataType.simpleString()
    scored = texts.mapInArrow(tidy(score), f"id {kind}, held_out boolean, n_tokens bigint, k bigint, b double, s double, rare array<struct<token: binary, g: int, n: bigint>>")
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = scored.select("row", F.inline("rare"))
    met = F.coalesce(F.col("c"), F.lit(0))
    lost = F.element_at(F.array(*(F.lit(float(x)) for x in unseen)), F.col("g") + 1)
    tail = (
        tail.join(model.rest, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(met > 0, F.col("n")).otherwise(0)).alias("k2"),
            F.sum(F.col("n") * F.log10((met + 1) / F.lit(float(places)))).alias("b2"),
            F.sum(F.col("n") * F.coalesce(F.element_at("fit", F.col("g") + 1), lost)).alias("s2"),
        )
    )
    whole = scored.drop("rare").join(tail, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("k", "k2").cast("bigint").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"), plus("b", "b2").alias("base_score"), plus("s", "s2").alias("score"))
