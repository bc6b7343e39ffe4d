"""Importance resampling towards a target distribution, from hashed n-gram counts.

Each task reads its texts a stretch at a time and builds a trie of the stretch's words: a node at
depth n is a run of n words and holds how often it occurs and the CRC-32 of its bytes, which is
continued from its parent's. Counting adds the nodes' counts to their buckets and hands on bucket
totals only; scoring builds the same tries, hangs each bucket's gain on its nodes and sums the
gains along every path that a document takes. All levels are arrays: a level's nodes are the
distinct pairs of a parent node and a word.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import tidy

#: Bytes of text per trie, about, and distinct words that a task remembers.
STRETCH, WORDS = 4 << 20, 1 << 20
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes of words (digits, letters in lower case, all of UTF-8's multi-byte ones) stay; others part words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _shifts(levels: int = 32) -> np.ndarray:
    """tables[k, j, v]: what byte ``j`` of value ``v`` of a CRC becomes after 2**k zero bytes."""
    value = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1).astype(np.uint32)
    tables = [value]
    for _ in range(levels - 1):
        tables.append(_through(tables[-1], tables[-1]))
    return np.stack(tables)


def _through(table, crc):
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


SHIFTS = _shifts()


def continued(crc, tail_crc, tail_length):
    """CRC-32 of head + tail from the CRCs of both and the tail's length, element by element."""
    out, k = crc.astype(np.uint32), 0
    while (1 << k) <= int(tail_length.max(initial=0)):
        hit = np.flatnonzero(tail_length >> k & 1)
        out[hit] = _through(SHIFTS[k], out[hit])
        k += 1
    return out ^ tail_crc


class Words:
    """The words of a task: number, CRC of the word, CRC and length of a space and the word."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((3, 1 << 12), np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.number
        new = list(set(words).difference(known))
        if new:
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            rows = np.array([[zlib.crc32(w) for w in new], [zlib.crc32(b" " + w) for w in new], [len(w) + 1 for w in new]], np.int64)
            while len(known) > self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
            self.rows[:, first : len(known)] = rows
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def stretches(texts):
    """From (row, bytes) pairs: lists of (row, words, context) of about STRETCH bytes in all.

    ``context``: how many of the words were the last ones of the part before; a text longer than
    STRETCH comes in parts that overlap by the two words that runs of three need.
    """
    parts, size = [], 0
    for row, text in texts:
        text, at, before = text.translate(LOWER), 0, []
        while True:
            end = text.find(b" ", at + STRETCH)
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            parts.append((row, before + words, len(before)))
            size += end - at
            if size >= STRETCH:
                yield parts
                parts, size = [], 0
            at, before = end, (before + words)[-2:]
            if at >= len(text):
                break
    if parts:
        yield parts


def levels(words: Words, parts, most: int = 3):
    """The trie of some parts, level by level: (CRC of each node, its count, the node and the row of
    each run of that many words). Only runs whose last word is not context count."""
    size = np.array([len(w) for _, w, _ in parts], np.int64)
    number = words.numbers([w for _, some, _ in parts for w in some])
    part = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size)
    own = place >= np.array([c for _, _, c in parts], np.int64)[part]
    row = np.array([r for r, _, _ in parts], np.int64)[part]
    total = len(words.number)
    node, start = number, np.arange(len(number))  # the node that the run from each start has reached
    crc = words.rows[0, :total].astype(np.uint32)
    for depth in range(1, most + 1):
        if depth > 1:
            last = start + 1
            go = last < len(number)
            go[go] = part[last[go]] == part[start[go] - depth + 2]
            key = node[go] * total + number[last[go]]
            made, node = np.unique(key, return_inverse=True)
            parent, tail = made // total, made % total
            crc = continued(crc[parent], words.rows[1, tail].astype(np.uint32), words.rows[2, tail])
            start = last[go]
        mine = own[start]
        yield crc, np.bincount(node[mine], minlength=len(crc)), node[mine], row[start[mine]]


def bucket_totals(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features of the one column of binary texts fall into each bucket, as
    partial totals of each task."""

    def run(batches):
        words, totals = Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for parts in stretches((0, t) for t in batch.column(0).to_pylist() if t):
                for crc, count, _, _ in levels(words, parts):
                    totals += np.bincount(crc % np.uint32(buckets), weights=count, minlength=buckets).astype(np.int64)
                if len(words.number) > WORDS:
                    words = Words()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["bucket", "n"])

    return texts.mapInArrow(tidy(run), "bucket int, n bigint")


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain; ``buckets`` rows reach the driver, however large the tables are."""
    both = bucket_totals(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    both = both.unionByName(bucket_totals(target, buckets).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    all_s, all_t = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def document_weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of doc_id and binary text."""
    kind = docs.schema[0].dataType.simpleString()

    def run(batches):
        words = Words()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            counts, weight = np.zeros((3, len(texts)), np.int64), np.zeros(len(texts), np.int64)
            for parts in stretches(enumerate(texts)):
                for depth, (crc, _, node, row) in enumerate(levels(words, parts)):
                    counts[depth] += np.bincount(row, minlength=len(texts))
                    np.add.at(weight, row, gains[crc % np.uint32(len(gains))][node])
                if len(words.number) > WORDS:
                    words = Words()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts[0]), pa.array(counts.sum(axis=0)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank.

    * Words are runs of ASCII letters (A-Z in lower case), digits and all other than ASCII characters;
      features are all runs of one to three words. Null and empty texts have no words and weight 0.
    * score is the weight plus a Gumbel number that seed and id fix, so the highest scores are a draw
      without replacement in proportion to exp(weight / 1000), and reruns agree.
    * Of the rows with at least ``least_words`` words, ``percent`` of a hundred, rounded down, are
      drawn and ranked; ties go to the smaller id, null ids last. Rows that repeat an id and a text
      tie and take ranks of their own. An empty table gives an empty result, an empty target only
      features that it lacks. Extra columns aren't read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    gains = bucket_gains(texts.select("text"), target.select(F.col(target_text_col).cast("binary").alias("text")), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = document_weights(texts, gains).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = materialise(scored, "importance-scores")
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]  # no two rows tie, so any range can be cut
    # one global order: the number of a row within its range of scores, and the rows of the ranges before
    placed = scored.filter(fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed, "importance-order")
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n"))  # a row per partition
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    share = placed.agg(F.floor(F.count("*") * F.lit(percent) / F.lit(100)).alias("drawn")).scalar()
    rank = F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(ranges), F.shiftright("place", 33) == F.col("range")).withColumn("rank", F.when(rank <= share, rank))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    everything = ranked.select(*out).unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("bigint")).select(*out))
    return everything.select(F.col("doc_id").alias(id_col), *out[1:])


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, all columns kept; rows of one id stay or go together."""
    drawn = importance_resample(docs, target, id_col=id_col, text_col=text_col, **params).filter(F.col("rank").isNotNull())
    drawn = drawn.select(F.col(id_col).alias("__drawn")).distinct()
    return docs.join(drawn, docs[id_col].eqNullSafe(F.col("__drawn")), "left_semi")
