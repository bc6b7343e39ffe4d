"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide.

1. One pass over the texts gives each document a digest of its words, one hash per band and a
   sketch, one byte of each MinHash. Documents with equal words form a class of copies; only its
   smallest id goes on.
2. Band hashes are shuffled. Buckets with the same members count once. Within a bucket a few leaders
   are compared with all members by their sketches, and members that may be near a common leader
   are tied together. Sketch distance obeys the triangle inequality, so no pair is parted that
   shares a bucket and whose sketches differ by less than five standard errors over what the
   threshold lets expect, and texts that merely share some boilerplate aren't chained together.
3. Tied members fetch their text once more and are compared on full sets. A component of ties is
   cut in blocks bounded by members and n-grams, each pair of blocks is one piece of work, and only
   link counts and a root per member leave it, never pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import tidy
from .components import connected_components
from .frames import first_rows, keyed, unused

WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.999, 256
#: Members of one side of a block comparison at most, n-grams of one side, and blocks that even a
#: component of fewer members is cut in (of ``BLOCK / 4`` members each at least), to spread it.
BLOCK, BLOCK_GRAMS, SPREAD = 1024, 1_000_000, 10
#: Leaders stand for all members whose sketches differ from theirs by so little.
LEADER = 0.1
#: Bytes of words whose hashes a worker remembers.
CACHE = 32 << 20
COLUMNS = 4096


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes by which a pair at
    ``similarity`` shares a band with probability ``recall``."""
    best = None
    for rows in range(1, most + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches that recall with so few hashes")
    return best


class _Hashes(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 150  # what an entry takes
        if self.held > CACHE:
            self.clear()
            self.held = len(word)
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngrams(words: list[bytes], hashes: dict, n: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word n-grams; a text of fewer words is one n-gram as a whole."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    out = np.full(max(len(w) - n, 0) + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(out)]
    return _mixed(out)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return (rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def band_hashes(grams: np.ndarray, bands: int, rows: int, factors) -> tuple[np.ndarray, bytes]:
    """One 64-bit hash per band of MinHashes of the n-grams, and one byte of each MinHash."""
    a, b = factors
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(low, (x[None, k : k + 2048] * a + b).min(1), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64), (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean matrix: which of ``left`` x ``right`` (indices of sets of distinct hashes) reach the
    similarity. Common n-grams are counted by products of blocks of a 0/1 matrix."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    who, column = who[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        w, k = who[i:j], column[i:j] - c
        l, r = (np.zeros((n, min(COLUMNS, width - c)), np.float32) for n in (len(left), len(right)))
        l[row_l[w][row_l[w] >= 0], k[row_l[w] >= 0]] = 1
        r[row_r[w][row_r[w] >= 0], k[row_r[w] >= 0]] = 1
        common += l @ r.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= similarity * union - 1e-6


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n nodes joined by edges (a, b)."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def ties(sketches: np.ndarray, far: float) -> np.ndarray:
    """For each row of equally long sketches the smallest index of the component it is tied to.

    Leaders, in order of rows, tie everything that differs from them in at most ``far + LEADER`` of
    all places and stand for everything within ``LEADER``. If two rows differ in at most ``far``,
    the leader that first stands for either ties both.
    """
    n, width = sketches.shape
    open_, edges = np.ones(n, bool), []
    for k in range(n):
        if open_[k]:
            apart = np.count_nonzero(sketches != sketches[k], axis=1)
            open_ &= apart > LEADER * width
            open_[k] = False
            near = np.flatnonzero(apart <= (far + LEADER) * width)
            edges.append((np.full(len(near), k), near))
    a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
    return _roots(n, a[a != b], b[a != b])


def _tie(far: float):
    """Arrow batches of (bucket, bi, bj, id, sketch), sorted by the first three: (a, b), ties."""

    def settle(rows, out):
        rows.sort(key=lambda r: r[3])
        root = ties(np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1), far)
        out += [(rows[k][3], rows[r][3]) for k, r in enumerate(root.tolist()) if r != k]

    def batch_of(out):
        a = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    def run(batches):
        open_: list = []
        for batch in batches:
            out: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0][:3] != row[:3]:
                    settle(open_, out)
                    open_ = []
                open_.append(row)
            yield batch_of(out)
        if open_:
            out = []
            settle(open_, out)
            yield batch_of(out)

    return run


def _compare(similarity: float):
    """Arrow batches of (comp, bi, bj, side, id, copies, grams), sorted by the first three and id:
    (id, links, root) for every linked member of each pair of blocks."""

    def settle(rows):
        ids = np.array([r[4] for r in rows])
        bi, bj = rows[0][1], rows[0][2]
        copies = np.array([r[5] for r in rows], np.int64)
        at = np.array([r[3] for r in rows])
        left, right = np.flatnonzero(at == bi), np.flatnonzero(at == bj)
        if not len(left) or not len(right):
            return _links()
        hit = links_within([r[6].view(np.uint64) for r in rows], left, right, similarity)
        links = np.zeros(len(ids), np.int64)
        if bi == bj:
            np.fill_diagonal(hit, False)
            links[left] = hit @ copies[right]
        else:
            links[left], links[right] = hit @ copies[right], hit.T @ copies[left]
        a, b = np.nonzero(hit)
        root, on = _roots(len(ids), left[a], right[b]), links > 0
        return _links(ids[on], links[on], ids[root][on])

    def run(batches):
        open_: list = []
        for batch in batches:
            grams = batch.column(6)
            offsets, values = grams.offsets.to_pylist(), np.asarray(grams.values)
            heads = [batch.column(k).to_pylist() for k in range(6)]
            for k, head in enumerate(zip(*heads, strict=True)):
                if open_ and open_[0][:3] != head[:3]:
                    yield settle(open_)
                    open_ = []
                open_.append((*head, values[offsets[k] : offsets[k + 1]].copy()))
        if open_:
            yield settle(open_)

    return run


def _links(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns or ([], [], [])], names=["id", "links", "root"])


def _in_blocks(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Each row once for every pair of blocks (bi <= bj) of its group that its own, ``side``, is in."""
    rows = rows.withColumn("blocks", blocks.cast("bigint")).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other"))
    return rows.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", "id")


def _linked(texts: DataFrame, unique: bool, n: int, similarity: float, recall: float, most_hashes: int, block: int, grams: int) -> tuple[DataFrame, DataFrame]:
    """``texts``: (id, text), where rows that repeat an id have the same text. (id, digest) of every
    row, and (digest, rep, class_id, n_links) of every class of copies."""
    bands, rows = choose_bands(similarity, recall, most_hashes)
    width = bands * rows
    far = 1 - similarity + 5 * math.sqrt(similarity * (1 - similarity) / width)

    def sign(batches):
        hashes, factors = _Hashes(), _factors(width)
        for batch in batches:
            digest, signature, sketch, size = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()
                found = ngrams(words, hashes, n)
                low, short = band_hashes(found, bands, rows, factors)
                digest.append(hashlib.md5(b" ".join(words)).digest())
                signature.append(low)
                sketch.append(short)
                size.append(len(found))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip((digest, signature, sketch, size), kinds, strict=True))], names=["id", "digest", "bands", "sketch", "size"])

    signed = materialise(texts.mapInArrow(tidy(sign), "id bigint, digest binary, bands array<bigint>, sketch binary, size bigint"), "signatures")
    copies = signed.groupBy("digest").agg(F.min(F.struct("id", "bands", "sketch", "size")).alias("first"), F.count("*").alias("copies"))
    copies = materialise(copies.select("digest", "copies", "first.*"), "classes")

    hung = copies.select("id", F.posexplode("bands").alias("band", "hash"))
    full = hung.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64("id")).alias("x")).filter("n > 1")
    alike = full.groupBy("n", "s", "x").agg(F.min(F.struct("band", "hash")).alias("one"))  # buckets of the same members
    buckets = alike.select("one.band", "one.hash", "n")
    inside = materialise(hung.join(buckets, ["band", "hash"]).select(F.xxhash64("band", "hash").alias("bucket"), "id", "n"), "buckets")
    sketched = inside.join(copies.select("id", "sketch"), "id")
    near = _in_blocks(sketched, "bucket", F.ceil(F.col("n") / block)).select("bucket", "bi", "bj", "id", "sketch").mapInArrow(tidy(_tie(far)), "a bigint, b bigint")
    members = materialise(connected_components(near), "members")
    members = members.join(copies.select("id", "copies", "size"), "id")
    sizes = members.groupBy("component").agg(F.count("*").alias("members"), F.sum("size").alias("grams"))
    members = materialise(members.drop("size").join(sizes, "component").withColumnRenamed("component", "comp"), "members")

    def to_sets(batches):
        hashes = _Hashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [np.unique(ngrams(t.encode("utf-8", "surrogatepass").split(), hashes, n)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(sets, pa.list_(pa.int64()))], names=["id", "comp", "members", "total", "copies", "grams"])

    found = (texts if unique else texts.dropDuplicates(["id"])).join(members, "id").select("id", "text", "comp", "members", F.col("grams").alias("total"), "copies")
    sets = found.mapInArrow(tidy(to_sets), "id bigint, comp bigint, members bigint, total bigint, copies bigint, grams array<bigint>")
    least = F.least(F.lit(SPREAD), F.ceil(F.col("members") * 4 / block))
    sets = _in_blocks(sets, "comp", F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("total") / grams), least))
    compared = materialise(sets.select("comp", "bi", "bj", "side", "id", "copies", "grams").mapInArrow(tidy(_compare(similarity)), "id bigint, links bigint, root bigint"), "compared")
    linked = compared.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected_components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = copies.select("digest", "id", "copies").join(linked, "id", "left").join(joined, "id", "left")
    return signed.select("id", "digest"), classes.select("digest", F.col("id").alias("rep"), F.coalesce("component", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def ngram_join(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES, block: int = BLOCK, grams: int = BLOCK_GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, copy_of, class_id, n_links.

    * Two documents are linked if the Jaccard similarity of their sets of word n-grams (words as
      split by ASCII white space, whole texts) reaches ``similarity``. A text of fewer than n
      words, empty and null ones among them, is one n-gram as a whole, linked to its equals.
    * ``copy_of``: smallest id with the same words. ``class_id``: smallest id of all that links
      lead to, copies included; the own id without links. ``n_links``: the other rows linked.
    * Pairs at the threshold share a band with probability ``recall``, more similar ones more; all
      verification is exact on sets of 64-bit n-gram hashes, equal words are told by 128 bits.
    * Ids of any type; null ids come last, and texts that share an id are documents of their own, in
      the order of their SHA-256. Rows that repeat id and text count as copies.
    * An empty table gives an empty result; other columns are ignored.
    """
    rows, plain = keyed(docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", "__id", "text")
    if not plain:
        rows = materialise(rows, "keyed")
    texts = rows.select("id", "text")
    signed, classes = _linked(texts, plain, n, similarity, recall, most_hashes, block, grams)
    out = signed.join(classes, "digest").select("id", "rep", "class_id", "n_links")
    if plain:
        kind = docs.schema[id_col].dataType
        return out.select(F.col("id").cast(kind).alias(id_col), F.col("rep").cast(kind).alias("copy_of"), F.col("class_id").cast(kind).alias("class_id"), "n_links")
    names = rows.select("id", "__id").distinct()
    for column, name in (("id", id_col), ("rep", "copy_of"), ("class_id", "__class")):
        out = out.join(names.select(F.col("id").alias("__key"), F.col("__id").alias(f"__{name}")), F.col(column) == F.col("__key")).drop("__key")
    return out.select(F.col(f"__{id_col}").alias(id_col), F.col("__copy_of").alias("copy_of"), F.col("____class").alias("class_id"), "n_links")


def drop_near_copies(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES, block: int = BLOCK, grams: int = BLOCK_GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class, null ids after all others. Documents
    that share an id, null or not, are told apart by their texts; of rows that repeat both, the one
    that sorts first by its columns stays. Null texts count as empty ones. An empty table gives an
    empty result; extra columns are kept."""
    name, key = unused(docs, "__stay"), unused(docs, "__key")
    rows, plain = keyed(docs, key, id_col, text_col)
    if not plain:
        rows = materialise(rows, "keyed")
    texts = rows.select(F.col(key).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    _, classes = _linked(texts, plain, n, similarity, recall, most_hashes, block, grams)
    stay = classes.filter("rep = class_id").select(F.col("rep").alias(name))
    kept = rows.join(stay, F.col(key) == F.col(name), "left_semi")
    return kept.drop(key) if plain else first_rows(kept, [key], docs.columns)
