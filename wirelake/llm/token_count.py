"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged arrays.

A piece holds white space marks only in front, so texts fall into words that no merge crosses.
The distinct words of a batch lie end to end in one array of symbols. In each round every word
applies its own lowest-rank pair, wherever that pair stands in it, all words at once; words
without a pair left drop out and what is left of them is counted.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import IntMap, tidy
from .byte_bpe import some_at_a_time

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Bytes, about, of the words whose counts a worker remembers, and what an entry takes besides its word.
CACHE, ENTRY = 64 << 20, 160


class PieceCounter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives a text.

    Needs a model without normalisation, with a dummy prefix, as the one named in the queries.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in usable}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece with white space inside: words can't be counted apart")
        scores = sorted({-model.get_score(i) for i in usable})
        place = {s: r for r, s in enumerate(scores)}
        self.rank_of = {i: place[-model.get_score(i)] for i in usable}
        rank = np.full(size, NONE, np.int32)
        rank[usable] = [self.rank_of[i] for i in usable]
        self.rank, self.size = rank, size
        left, right, made = [], [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        self.made = IntMap(np.array(left, np.int64) * size + np.array(right, np.int64), made)
        self.pair = {(a, b): m for a, b, m in zip(left, right, made, strict=True)}
        self.single = {p: i for p, i in pieces.items() if len(p) == 1}
        inside = set().union(*(p for p in pieces if len(p) > 1))
        # characters that no longer piece holds stand alone; splitting there makes words repeat
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]+" if alone else "")).findall
        self.counts: dict[str, int] = {}
        self.held = 0

    def exact(self, word: str) -> int:
        """Merge lowest rank first, leftmost on ties; the count of one word."""
        ids = [self.single.get(c, -1 - len(c.encode("utf-8", "surrogatepass"))) for c in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank_of[self.pair[p]], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pair]
        heapq.heapify(heap)
        gone = None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            m = self.pair[a, b]
            ids[i], ids[j], after[i] = m, gone, after[j]
            k = after[i]
            if k < len(ids):
                before[k] = i
                if (m, ids[k]) in self.pair:
                    heapq.heappush(heap, (self.rank_of[self.pair[m, ids[k]]], i, m, ids[k]))
            if before[i] >= 0 and (ids[before[i]], m) in self.pair:
                heapq.heappush(heap, (self.rank_of[self.pair[ids[before[i]], m]], before[i], ids[before[i]], m))
        return sum(1 if i >= 0 else -1 - i for i in ids if i is not gone)

    def _pairs(self, a, b):
        """Piece that each pair makes, -1 for none."""
        known = (a >= 0) & (b >= 0)
        return np.where(known, self.made.find(np.where(known, a.astype(np.int64) * self.size + b, 0)), -1)

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each non-empty word."""
        get = self.single.get
        sym = np.array([get(c, -1 - len(c.encode("utf-8", "surrogatepass"))) for w in words for c in w], np.int32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        total = np.zeros(len(words), np.int64)
        slow: list[np.ndarray] = []
        pair = np.append(self._pairs(sym[:-1], sym[1:]), -1)
        pair[:-1][word[1:] != word[:-1]] = -1
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            start = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            if (low == NONE).any():  # count what is left of finished words
                stay = np.repeat(low != NONE, length)
                total += np.bincount(word[~stay], np.where(sym[~stay] >= 0, 1, -1 - sym[~stay]), len(words)).astype(np.int64)
                sym, word, pair, rank = sym[stay], word[stay], pair[stay], rank[stay]
                low, length = low[low != NONE], length[low != NONE]
                if not len(sym):
                    break
            low = np.repeat(low, length)
            hit = rank == low
            # of neighbouring hits in one word every second one merges, from the left
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(~hit | (np.diff(word, prepend=-1) != 0), np.arange(len(hit)) - hit, -1)) - 1
            first = hit & (run % 2 == 0)
            i = np.flatnonzero(first)
            old_right = np.append(sym, -2)[i + 2]
            same = np.append(word, -1)[i + 2] == word[i]
            sym[i] = pair[i]
            early = self._pairs(sym[i], np.where(same, old_right, -2))
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            at = np.cumsum(keep)[i] - 1
            sym, word, pair, low = sym[keep], word[keep], pair[keep], low[keep]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            nxt = np.minimum(touched + 1, len(sym) - 1)
            fresh = self._pairs(sym[touched], sym[nxt])
            fresh[(nxt == touched) | (word[nxt] != word[touched])] = -1
            pair[touched] = fresh
            # a new pair that should have gone before the others of this round: merge that word alone
            wrong = np.concatenate([word[touched[(fresh >= 0) & (self.rank[fresh] <= low[touched])]], word[at[(early >= 0) & (self.rank[early] <= low[at])]]])
            if len(wrong):
                wrong = np.unique(wrong)
                slow.append(wrong)
                stay = ~np.isin(word, wrong)
                sym, word, pair = sym[stay], word[stay], pair[stay]
        for w in np.concatenate(slow).tolist() if slow else ():
            total[w] = self.exact(words[w])
        return total

    def forget(self) -> None:
        """Drop the words remembered."""
        self.counts.clear()
        self.held = 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.counts)) if split else []
        size = lambda some: sum(map(len, some)) * 2 + ENTRY * len(some)
        self.held += size(new)
        if self.held > CACHE:
            self.forget()
            new = list(set().union(*split))
            self.held = size(new)
        if new:
            self.counts.update(zip(new, self.count_words(new).tolist(), strict=True))
        get = self.counts.__getitem__
        return [sum(map(get, w)) for w in split]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts, without begin or end tokens; null and empty texts have 0 bytes and tokens. Rows
    are independent: repeated rows and ids, null ids and empty tables need no care, and other
    columns are ignored. ``path`` names a sentencepiece file that every executor has.
    """

    def run(batches):
        counter = load(path)
        for batch in batches:
            n = [c for texts in some_at_a_time(batch.column(2).to_pylist()) for c in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("__text"))
    return rows.mapInArrow(tidy(run, lambda: load(path).forget()), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
