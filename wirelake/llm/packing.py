"""Packing documents into sequences of bounded length: a linear grouping scheme, then best fit.

A length is at most the capacity, so the counts of all pieces by length are a table of ``capacity``
rows whatever the corpus holds. From it alone the driver draws up a plan: large lengths in groups of
equal cardinality, each rounded up to its largest; the best configurations of rounded lengths by
column generation; then leftovers and small lengths by best fit, a run of like sequences at a time.
The plan says for every interval of ranks, in the order of falling lengths, which sequences it
fills, and stays as small as the table. Ranks come from one global sort of the pieces.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import tidy
from .byte_bpe import PATTERN, byte_letters, some_at_a_time
from .frames import unused

#: Lengths over this share of the capacity are large, and the numbers of groups that a plan tries.
LARGE, GROUPS = 1 / 8, (24, 48, 96)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to arrays of ids, for a tokenizers file.

    A plain byte-level BPE file whose ids follow its merges can be run by tiktoken, which gives
    the same ids in a quarter of the time; any other is run by tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, model, added = spec["model"]["vocab"], spec["model"], spec["added_tokens"]
    merges = [vocab["".join(m if isinstance(m, list) else m.split(" ", 1))] for m in model.get("merges", ())]
    before = spec.get("pre_tokenizer") or {}
    plain = (
        (model["type"], before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("BPE", "ByteLevel", False, True)
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and merges == sorted(set(merges))
        and len(vocab) == len(merges) + 256
        and max((vocab[c] for c in byte_letters()), default=0) < min(merges, default=1 << 31)
    )
    if not plain:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        return lambda texts: [np.array(e.ids, np.uint32) for e in library.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [own.encode_to_numpy(t, allowed_special="all") for t in texts]


def pieces_of(docs: DataFrame, path: str, capacity: int = 1024, end: int | None = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, token_ids]): the ids of each whole text and ``end``,
    cut into pieces of ``capacity``, the first of which takes what is over. Null is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            row, out, all_ids = 0, [], []
            for texts in some_at_a_time(batch.column(1).to_pylist()):
                for ids in encode(texts):
                    if end is not None:
                        ids = np.append(ids, np.uint32(end))
                    cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity), len(ids)] if len(ids) else [0, 0]
                    for piece, (a, b) in enumerate(zip(cut, cut[1:])):
                        out.append((row, piece, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())))
                        if with_ids:
                            all_ids.append(ids[a:b].astype(np.int32))
                    row += 1
            row, *rest = (np.array(out, np.int64).reshape(-1, 5)).T
            arrays = [batch.column(0).take(pa.array(row)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])]
            arrays += [pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "token_ids"][: len(arrays)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ddl = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", token_ids array<int>" if with_ids else "")
    return rows.mapInArrow(tidy(run), ddl)


def _configuration(value: np.ndarray, size: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """The multiset of at most ``most`` sizes within ``capacity`` of the greatest value (a knapsack)."""
    best, took = np.zeros(capacity + 1), []
    for _ in range(most):
        with_one = np.full((len(size), capacity + 1), -1.0)
        for k, s in enumerate(size):
            with_one[k, s:] = best[: capacity + 1 - s] + value[k]
        pick = np.argmax(with_one, axis=0)
        new = with_one[pick, np.arange(capacity + 1)]
        better = new > best + 1e-12
        took.append(np.where(better, pick, -1))
        best = np.where(better, new, best)
    count, room = np.zeros(len(size), np.int64), capacity
    for step in reversed(took):
        if step[room] >= 0:
            count[step[room]] += 1
            room -= size[step[room]]
    return count


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how often each size, how many sequences): the linear program of few sizes, rounded down.

    Column generation: start with one size per sequence; while some configuration is worth more
    than a sequence at the sizes' present prices, let it into the basis.
    """
    per = capacity // size
    basis, inverse = np.diag(per), np.diag(1.0 / per)
    share = demand / demand.sum()
    amount, most = inverse @ share, int(capacity // size.min())
    for _ in range(40 * len(size)):
        price = np.ones(len(size)) @ inverse
        new = _configuration(np.maximum(price, 0), size, capacity, most)
        if price @ new < 1 + 1e-7:
            break
        turn = inverse @ new
        limit = np.where(turn > 1e-10, amount / np.where(turn > 1e-10, turn, 1), np.inf)
        out = int(np.argmin(limit))
        amount = np.maximum(amount - limit[out] * turn, 0)
        amount[out] = limit[out]
        inverse[out] /= turn[out]
        others = np.arange(len(size)) != out
        inverse[others] -= np.outer(turn[others], inverse[out])
        basis[:, out] = new
    whole = np.floor(amount * demand.sum() + 1e-6).astype(np.int64)
    return [(basis[:, k], int(n)) for k, n in enumerate(whole) if n > 0]


class _Plan:
    """Sequences in runs of equal use, and what fills them: intervals of ranks by falling length."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.copy()
        self.rank = np.cumsum(counts[::-1])[::-1] - counts  # of the next piece of each length
        self.intervals: list[tuple[int, int, int, int]] = []
        self.sequences = 0
        self.free: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of (first sequence, how many)

    def fill(self, length: int, first: int, sequences: int, each: int, offset: int) -> None:
        """The next pieces of ``length`` into ``sequences`` from ``first`` on, ``each`` in a row."""
        self.intervals.append((int(self.rank[length]), first, each, offset))
        self.rank[length] += sequences * each
        self.left[length] -= sequences * each

    def keep(self, first: int, sequences: int, free: int) -> None:
        if sequences and free:
            self.free.setdefault(free, []).append((first, sequences))

    def configured(self, spans: list[tuple[int, int]], takes: np.ndarray, sequences: int) -> None:
        """At most ``sequences`` new ones that take so many pieces of each group, the longest first.

        What rounding left over in a sequence goes to its last piece, which may be that much longer
        than its group. A configuration whose groups have run out is left to best fit.
        """
        slots = [spans[g] for g in np.flatnonzero(takes) for _ in range(takes[g])]
        while sequences:
            chosen: list[int] = []
            for k, (size, least) in enumerate(slots):
                most = self.capacity - sum(chosen) if k == len(slots) - 1 else size
                fits = [n for n in np.flatnonzero(self.left[least : most + 1])[: -len(slots) - 1 : -1] + least if self.left[n] > chosen.count(n)]
                if not fits:
                    return
                chosen.append(int(fits[0]))
            some = min(sequences, *(int(self.left[n]) // chosen.count(n) for n in chosen))
            used = 0
            for length in chosen:
                self.fill(length, self.sequences, some, 1, used)
                used += length
            self.keep(self.sequences, some, self.capacity - used)
            self.sequences, sequences = self.sequences + some, sequences - some

    def best_fit(self) -> None:
        """All that is left, falling lengths, each into the fullest sequences that it fits."""
        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                room = min((f for f in self.free if f >= length), default=0)
                if room:
                    first, some = self.free[room].pop()
                    if not self.free[room]:
                        del self.free[room]
                else:
                    room, each = self.capacity, self.capacity // length
                    first, some = self.sequences, -(-n // each)
                    self.sequences += some
                each = room // length
                full = min(some, n // each)
                if full:
                    self.fill(length, first, full, each, self.capacity - room)
                    self.keep(first, full, room - each * length)
                rest = min(n - full * each, each - 1) if full < some else 0
                if rest:  # one more sequence takes what is left
                    self.fill(length, first + full, 1, rest, self.capacity - room)
                    self.keep(first + full, 1, room - rest * length)
                    full += 1
                self.keep(first + full, some - full, room)


def grouped(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, int, int]]:
    """(largest length, least length, pieces): the pieces from ``least`` on, by falling length, in
    groups of as many pieces each, as nearly as whole lengths allow."""
    total, out, at = int(counts[least:].sum()), [], 0
    for length in range(len(counts) - 1, least - 1, -1):
        n = int(counts[length])
        if n:
            if out and at * groups // total == (at - out[-1][2]) * groups // total:
                out[-1] = (out[-1][0], length, out[-1][2] + n)
            else:
                out.append((length, length, n))
            at += n
    return out


def packing_plan(counts: np.ndarray, groups=GROUPS, large: float = LARGE) -> _Plan:
    """``counts``: how many pieces there are of each length from 0 to the capacity. The plan with the
    fewest sequences over several numbers of groups."""
    counts = np.asarray(counts, np.int64)
    best, least = None, int((len(counts) - 1) * large) + 1
    for g in groups:
        plan = _Plan(counts)
        some = grouped(counts, least, g)
        if some:
            size, _, demand = np.array(some, np.int64).T
            for takes, n in configurations(size, demand, plan.capacity):
                plan.configured([(hi, lo) for hi, lo, _ in some], takes, n)
        plan.best_fit()
        if best is None or plan.sequences < best.sequences:
            best = plan
    return best


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` from 0 to ``capacity``) with sequence_id and offset.

    Pieces of length 0 belong to no sequence: both are null. An empty table gives an empty result.
    """
    row, place, at, ahead = (unused(pieces, n) for n in ("__row", "__place", "__range", "__ahead"))
    pieces = materialise(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for found in pieces.groupBy("length").count().collect():  # capacity + 1 rows at most
        counts[found["length"]] = found["count"]
    some = packing_plan(np.concatenate([[0], counts[1:]])).intervals
    from_rank, base, each, offset = np.array(sorted(some) or [(0, 0, 1, 0)], np.int64).T
    # ranks by falling length: a row's number within its range of the global order, and the rows before
    order = [F.col("length").desc(), F.col(row)]
    placed = pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    placed = materialise(placed, "pieces-by-length")
    ranges = placed.groupBy(F.shiftright(place, 33).alias(at)).agg(F.count("*").alias("n"))  # a row per partition
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    rank = F.col(ahead) + F.col(place).bitwiseAND((1 << 33) - 1)
    ranked = placed.join(F.broadcast(ranges), F.shiftright(place, 33) == F.col(at)).withColumn(place, rank)
    names = [c for c in pieces.columns if c not in (row, "sequence_id", "offset")]
    ranked = ranked.select(*names, F.col(place).alias(place))

    def run(batches):
        for batch in batches:
            ranks, length = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in (place, "length"))
            k = np.maximum(np.searchsorted(from_rank, ranks, "right") - 1, 0)
            step, none = ranks - from_rank[k], length == 0
            where = pa.array(base[k] + step // each[k], mask=none), pa.array(offset[k] + step % each[k] * length, mask=none)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *where], names=[*names, "sequence_id", "offset"])

    schema = ranked.drop(place).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end: int | None = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset[, token_ids].

    Null and empty texts are one piece that holds ``end`` alone; texts of any length are cut into
    pieces. Rows that repeat an id or all columns give pieces of their own, null ids too; an empty
    table gives an empty result; extra columns aren't read. Within a sequence pieces follow each
    other without gaps.
    """
    out = packed(pieces_of(docs, path, capacity, end, with_ids, id_col, text_col), capacity)
    return out.select(F.col("doc_id").alias(id_col), *[c for c in out.columns if c != "doc_id"])


def packed_sequences(docs: DataFrame, path: str, capacity: int = 1024, **params) -> DataFrame:
    """(sequence_id, token_ids, doc_ids): the sequences themselves, each of at most ``capacity`` ids."""
    id_col = params.get("id_col", "doc_id")
    rows = pack_documents(docs, path, capacity, with_ids=True, **params).filter(F.col("sequence_id").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("offset", "token_ids", F.col(id_col).alias("doc"))))
    rows = rows.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.token_ids").alias("token_ids"), F.col("parts.doc").alias("doc_ids"))
