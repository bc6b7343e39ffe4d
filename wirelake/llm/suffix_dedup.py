"""Removal of long byte strings that occur earlier in the corpus, by a run-length suffix index.

Exact for every string of ``depth`` bytes, without comparing all texts with each other:

1. Every string of ``depth`` bytes picks one part of it, its minimiser, as anchor. Equal strings
   pick equal anchors. Strings that follow each other and share an anchor make a segment.
2. Segments are shuffled as hashes, without text, and meet by anchor. Equal ones fold to their
   first occurrence, all others are covered; a segment whose anchor nothing else has is done.
3. The rest fetches its bytes. A run-length Burrows-Wheeler index of each anchor's different
   segments, with sampled run ends, is built, each segment is streamed backwards through it, and
   strings whose statistic reaches ``depth`` at an earlier place are marked.
4. Marks go back to their documents, which drop the bytes they cover.

An index stays small however common an anchor is: an anchor with more than ``group`` different
segments is cut anew with longer anchors, at last with whole strings of ``depth`` bytes, of which
one anchor has but one. A task that sees an anchor very often says so once and cuts it anew at
once, so the rows that meet for one anchor don't grow with the documents that hold it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import ranges, tidy
from .frames import keyed
from .rindex import RunLengthIndex

DEPTH, ANCHOR = 100, 40
#: Most different segments of an anchor that one index takes, bytes at which an index of several
#: anchors is closed, and segments of an anchor after which a task cuts it anew.
GROUP, INDEX_BYTES, OFTEN = 400, 1 << 17, 64
#: Bytes hashed at a time: of one text, of several laid end to end, and of a slice that is folded.
_PIECE, _BLOCK, _SLICE = 1 << 18, 1 << 16, 1 << 22
_LOW = np.uint64((1 << 23) - 1)
_MUL = np.uint64(0x100000001B3)
#: Kinds of rows, beside segments, whose kind is the level of their anchor.
SPAN, ASK, ANEW = -1, -2, -3
_COLUMNS = "kind int, h bigint, s bigint, id bigint, at bigint, size int"
_TYPES = (np.int32, np.int64, np.int64, np.int64, np.int64, np.int32)
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(0x9E3779B97F4A7C15, 2 * _PIECE)
_DOWN = _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), 2 * _PIECE)
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _gram_hashes(a: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all parts of ``length`` bytes, put together from those of powers of two."""
    power = lambda n: np.uint64(pow(int(_MUL), n, 1 << 64))
    square, size, out, done = a.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if length & size:
            if out is None:
                out, done = square, size
            else:
                n = min(len(out), len(square) - done)
                out, done = out[:n] * power(size) + square[done : done + n], done + size
        if done == length:
            return _mixed(out)
        square, size = square[:-size] * power(size) + square[size:], size * 2


def segments(raws: list[bytes], depth: int = DEPTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, hash, first, last, content): for runs of starts of ``depth``-byte strings that share
    their leftmost minimiser, the text's number, the minimiser's hash, the first and last start,
    and a hash of all bytes of the run."""
    out: list = []
    block, size = [], 0
    for k, raw in enumerate(raws):
        for at in range(0, max(len(raw) - depth + 1, 0), _PIECE):
            block.append((k, at, raw[at : at + _PIECE + depth - 1] if len(raw) > _PIECE else raw))
            size += len(block[-1][2])
            if size >= _BLOCK:
                out.append(_segments_of(block, depth, anchor))
                block, size = [], 0
    if block:
        out.append(_segments_of(block, depth, anchor))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _segments_of(block, depth: int, anchor: int):
    """``segments`` of pieces (text, place in it, bytes) laid end to end; no string crosses one."""
    lengths = np.array([len(b) for _, _, b in block], np.int64)
    begins = np.cumsum(lengths) - lengths
    a = np.frombuffer(b"".join(b for _, _, b in block), np.uint8)
    h = _gram_hashes(a, anchor)
    low, wide, span = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), depth - anchor + 1, 1
    while span < wide:  # minima of ever wider windows
        by = min(span, wide - span)
        low = np.minimum(low[:-by], low[by:])
        span += by
    low &= _LOW
    counts = lengths - depth + 1
    start = ranges(begins, counts)
    low = low[start].astype(np.int64)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[np.cumsum(counts) - counts] = True
    edge = np.flatnonzero(new)
    piece = np.repeat(np.arange(len(block)), counts)[edge]
    text, place = (np.array([b[k] for b in block], np.int64) for k in (0, 1))
    size = np.diff(np.append(edge, len(low))) + depth - 1
    begin = start[edge]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * _UP[: len(a)], out=total[1:])
    content = _mixed((total[begin + size] - total[begin]) * _DOWN[begin] + size.astype(np.uint64))
    first = begin - begins[piece] + place[piece]
    return text[piece], h[low[edge]].view(np.int64), first, first + size - depth, content.view(np.int64)


def _rows(columns: dict) -> pa.RecordBatch:
    n = max((len(v) for v in columns.values() if isinstance(v, np.ndarray)), default=0)
    whole = (columns.get(name, 0) for name in _NAMES)
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(v, t), n)) for v, t in zip(whole, _TYPES, strict=True)], names=_NAMES)


def _joined(owner: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Spans that touch within an owner made one; sorted by owner and start."""
    if not len(owner):
        return owner, start, stop
    base = owner * (int(stop.max()) + 1)  # further owners lie beyond all spans of earlier ones
    reach = np.maximum.accumulate(base + stop)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | ((base + start)[1:] > reach[:-1])
    edge = np.flatnonzero(new)
    return owner[edge], start[edge], (reach - base)[np.append(edge[1:], len(owner)) - 1]


def _cut(depth: int, anchors: list[int], level: int, often: int = OFTEN):
    """Batches of (id, raw) or (id, raw, pieces): segments of the texts or of those pieces of them,
    each different one of a slice once; spans of those that a slice has earlier."""

    def fold(pieces, level, hot):
        """Rows of pieces (id, place, bytes), sorted by id and place."""
        text, h, first, last, s = segments([p[2] for p in pieces], depth, anchors[level])
        ids, places = (np.array([p[k] for p in pieces], np.int64) for k in (0, 1))
        key = h * np.int64(-0x61C8864680B583EB) ^ s
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (s[order[1:]] != s[order[:-1]])
        again = np.sort(order[~new])
        # a string that another slice or piece puts at the same place is no copy: pieces are disjoint
        owner, start, stop = _joined(text[again], first[again], last[again] + depth)
        yield _rows({"kind": SPAN, "h": ids[owner] * 31 + start, "id": ids[owner], "at": places[owner] + start, "size": stop - start})
        keep = order[new]
        if level + 1 < len(anchors):
            value, count = np.unique(h[keep], return_counts=True)
            fresh = np.setdiff1d(value[count > often], hot[level])
            if len(fresh):
                hot[level] = np.union1d(hot[level] if len(hot[level]) < 1 << 16 else fresh, fresh)
                yield _rows({"kind": level, "h": fresh, "s": np.iinfo(np.int64).min})
            anew = np.isin(h[keep], hot[level]) if len(hot[level]) else np.zeros(len(keep), bool)
            finer = np.sort(keep[anew])
            if len(finer):
                cut = [(int(ids[t]), int(places[t]) + a, pieces[t][2][a : b + depth]) for t, a, b in zip(text[finer].tolist(), first[finer].tolist(), last[finer].tolist(), strict=True)]
                yield from fold(cut, level + 1, hot)
            keep = keep[~anew]
        yield _rows({"kind": level, "h": h[keep], "s": s[keep], "id": ids[text[keep]], "at": places[text[keep]] + first[keep], "size": last[keep] - first[keep] + depth})

    def run(batches):
        hot = [np.zeros(0, np.int64) for _ in anchors]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            asked = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            held, size = [], 0
            for k in sorted(range(len(ids)), key=ids.__getitem__):
                raw = batch.column(1)[k].as_py()
                for at, n in sorted((p["at"], p["size"]) for p in asked[k]) if asked else [(0, len(raw))]:
                    held.append((ids[k], at, raw[at : at + n]))
                    size += n
                if size >= _SLICE:
                    yield from fold(held, level, hot)
                    held, size = [], 0
            if held:
                yield from fold(held, level, hot)

    return run


def _meet(level: int, last: bool, group: int):
    """Rows sorted by (h, s, id, at): what becomes of each segment. Rows of other kinds pass.
    Holds at most ``group`` segments of the anchor whose rows have not ended."""

    def run(batches):
        held, open_ = None, None  # columns of the first segments of the last anchor, once it is cut anew its hash

        def settle(c, final):
            nonlocal held, open_
            kind, h, s, ids, at, size = c
            n = len(h)
            if not n:
                return
            start = np.ones(n, bool)
            start[1:] = h[1:] != h[:-1]
            first = start.copy()
            first[1:] |= s[1:] != s[:-1]
            marker = size == 0
            gid = np.cumsum(start) - 1
            count = np.bincount(gid, first & ~marker)
            many = (np.bincount(gid, marker) > 0) | (count > group)
            if open_ is not None:
                many[0] |= h[0] == open_
            many &= not last
            told = np.zeros(n, bool)
            if open_ is not None and h[0] == open_:
                told[0] = True
            first &= ~marker & ~told
            copies = ~first & ~marker & ~told
            hot = many[gid]
            ask, anew = first & ~hot & (count[gid] > 1), first & hot
            rest = np.zeros(n, bool)
            if not final:
                end = gid == gid[-1]
                rest = (first | marker | told) & end
                if hot[-1]:
                    open_, stay = h[-1], np.flatnonzero(rest)[-1:]
                else:
                    open_, stay = None, np.flatnonzero(rest)
                    ask &= ~end
                    anew &= ~end
                held = [v[stay] for v in c]
            yield _rows({"kind": SPAN, "id": ids[copies], "at": at[copies], "size": size[copies]})
            yield _rows({"kind": ASK, "h": h[ask], "id": ids[ask], "at": at[ask], "size": size[ask]})
            yield _rows({"kind": ANEW, "id": ids[anew], "at": at[anew], "size": size[anew]})

        for batch in batches:
            c = [np.asarray(v) for v in batch.columns]
            mine = c[0] == level
            if not mine.all():
                yield batch.filter(pa.array(~mine))
            c = [v[mine] for v in c]
            if held is not None:
                c, held = [np.concatenate(v) for v in zip(held, c, strict=True)], None
            yield from settle(c, False)
        if held is not None:
            yield from settle(held, True)

    return run


def _pick(batches):
    """(h, id, at, seg): the segments asked for of each text."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            raws, wanted = part.column(1).to_pylist(), part.column(2)
            owner = np.repeat(np.arange(len(raws)), np.diff(np.asarray(wanted.offsets)))
            h, at, size = (wanted.flatten().field(name) for name in ("h", "at", "size"))
            seg = [raws[o][a : a + n] for o, a, n in zip(owner.tolist(), at.to_pylist(), size.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([h, part.column(0).take(pa.array(owner)), at, pa.array(seg, pa.binary())], names=["h", "id", "at", "seg"])


def _spans(flags: np.ndarray, at: int, depth: int):
    """Byte spans that the flagged starts cover, merged where they touch within the run."""
    on = np.flatnonzero(flags)
    if not len(on):
        return []
    cut = np.flatnonzero(np.diff(on) > 1)
    return [(at + a, at + b + depth) for a, b in zip(on[np.append(0, cut + 1)].tolist(), on[np.append(cut, len(on) - 1)].tolist(), strict=True)]


def _mark(depth: int):
    """Rows (h, id, at, seg) sorted by h: spans that occur earlier in their group."""

    def settle(rows, out):
        rows.sort(key=lambda r: (r[1], r[2]))
        index = RunLengthIndex([r[3] for r in rows], depth)
        for r, flags in zip(rows, index.earlier([len(r[3]) - depth + 1 for r in rows]), strict=True):
            for a, b in _spans(flags, r[2], depth):
                out.append((r[1], a, b - a))

    def batch_of(out):
        a = np.array(out, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(a[:, k].astype(t)) for k, t in enumerate((np.int64, np.int64, np.int32))], names=["id", "at", "size"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            out: list = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if r[0] != last and size > INDEX_BYTES:
                    settle(rows, out)
                    rows, size = [], 0
                rows.append(r)
                size, last = size + len(r[3]) + 1, r[0]
            yield batch_of(out)
        if rows:
            out = []
            settle(rows, out)
            yield batch_of(out)

    return run


def _apply(batches):
    """What marks (at, size) take from each text."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "sha"]
    for batch in batches:
        out: list = []
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            raws, marks = part.column(1).to_pylist(), part.column(2)
            owner = np.repeat(np.arange(len(raws)), np.diff(np.asarray(marks.offsets)))
            at, size = (np.asarray(marks.flatten().field(name)).astype(np.int64) for name in ("at", "size"))
            order = np.lexsort((at, owner))
            owner, start, stop = _joined(owner[order], at[order], (at + size)[order])
            cut = np.searchsorted(owner, np.arange(len(raws) + 1))
            for j, raw in enumerate(raws):
                a, b = start[cut[j] : cut[j + 1]].tolist(), stop[cut[j] : cut[j + 1]].tolist()
                kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True)) if a else raw
                out.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)


def repeated_spans(texts: DataFrame, depth: int = DEPTH, group: int = GROUP, often: int = OFTEN) -> DataFrame:
    """``texts``: (id, raw) with unique whole-number ids and bytes. Spans (id, at, size) of bytes that
    are covered by a ``depth``-byte string that also starts earlier; they may overlap."""
    if not 16 <= depth <= _PIECE // 2:
        raise ValueError(f"depth must be from 16 to {_PIECE // 2}")
    short = min(ANCHOR, depth // 2)
    anchors = [short, (short + depth + 1) // 2, depth]
    long = texts.filter(F.length("raw") >= depth)
    fetch = lambda wanted, *names: long.join(wanted.groupBy("id").agg(F.collect_list(F.struct(*names)).alias("wanted")), "id").select("id", "raw", "wanted")
    rounds: list[DataFrame] = []
    for level in range(len(anchors)):
        source = long if not level else fetch(rounds[-1].filter(F.col("kind") == ANEW), "at", "size")
        rows = source.mapInArrow(tidy(_cut(depth, anchors, level, often)), _COLUMNS)
        if level:
            rows = rows.unionByName(rounds[-1].filter(F.col("kind") >= level))
        met = rows.repartition("h").sortWithinPartitions("h", "s", "id", "at").mapInArrow(tidy(_meet(level, level + 1 == len(anchors), group)), _COLUMNS)
        rounds.append(materialise(met, "segments"))
        if rounds[-1].filter((F.col("kind") == ANEW) | (F.col("kind") > level)).isEmpty():
            break
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    picked = fetch(every.filter(F.col("kind") == ASK), "h", "at", "size").mapInArrow(tidy(_pick), "h bigint, id bigint, at bigint, seg binary")
    unlike = picked.repartition("h").sortWithinPartitions("h", "id", "at").mapInArrow(tidy(_mark(depth)), "id bigint, at bigint, size int")
    return every.filter(F.col("kind") == SPAN).select("id", "at", "size").unionByName(unlike)


def suffix_dedup(docs: DataFrame, depth: int = DEPTH, group: int = GROUP, often: int = OFTEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    * A byte goes if a ``depth``-byte string that covers it also starts earlier: in a document of
      smaller id, or further left in the same one, overlaps included. Strings never cross
      documents and are judged on the input. Null, empty and shorter texts lose nothing.
    * Ids of any type; null ids come last, and texts that share an id stand in the order of their
      SHA-256. Rows that repeat id and text are one document and give the same row each.
    * Strings count as equal by two independent hashes of 64 bits or, within an index, by their bytes.
    * An empty table gives an empty result; other columns are ignored.
    """
    key = "__key"
    raw = F.coalesce(F.col("__text"), F.lit("")).cast("binary")
    rows, plain = keyed(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), key, "__id", "__text")
    texts = rows.select(F.col(key).alias("id"), raw.alias("raw"))
    if not plain:
        texts = texts.dropDuplicates(["id"])
    marks = repeated_spans(texts, depth, group, often).groupBy("id").agg(F.collect_list(F.struct("at", "size")).alias("marks"))
    none = F.array().cast("array<struct<at: bigint, size: int>>")
    judged = texts.join(marks, "id", "left").select("id", "raw", F.coalesce("marks", none).alias("marks")).mapInArrow(tidy(_apply), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, sha string")
    if not plain:
        judged = rows.select(F.col("__id"), F.col(key).alias("id")).join(judged, "id")
    else:
        judged = judged.withColumn("__id", F.col("id").cast(docs.schema[id_col].dataType))
    return judged.select(F.col("__id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))
