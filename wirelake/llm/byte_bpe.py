"""Byte-level BPE encoding and decoding: speculate, verify, repair.

For the distinct pre-tokens of a batch, greedy longest match over a trie proposes tokens for all
of them at once. A proposal is the true encoding exactly if each token encodes to itself and no
adjacent pair could have merged across their border first; both are tested for all pairs in a few
array operations. The few pre-tokens that fail are merged exactly, one by one.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import IntMap, tidy

#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int32(2**31 - 1)
#: Pre-tokens longer than this are matched one at a time: they would hold up the batch.
LONG = 512
#: Bytes, about, of the words that a worker remembers, and what an entry takes besides its word.
CACHE, ENTRY = 64 << 20, 320


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the rest, in order, for those from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder over a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.merge = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.rank_of_pair = IntMap(left * self.size + right, np.arange(len(merges)))
        self.born = np.full(self.size, -1, np.int32)  # rank at which a token is made; -1: a byte
        self.left, self.right = np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        for r in range(len(merges) - 1, -1, -1):
            self.born[made[r]], self.left[made[r]], self.right[made[r]] = r, left[r], right[r]
        self.byte_list = [vocab[c] for c in byte_letters()]
        self.byte_id = np.array(self.byte_list, np.int32)
        self.made = made
        # Verification presumes that a merge comes after those that make its parts.
        self.ordered = bool(np.all(np.arange(len(merges)) > np.maximum(self.born[left], self.born[right])))
        self._build_trie(vocab.values())
        self._own()
        self.find = regex.compile(PATTERN).findall
        self.held = 0
        self.words: dict[str, str] = {}
        self.plain: dict[str, bytes] = {}

    def _build_trie(self, ids: Iterable[int]) -> None:
        nodes: dict[int, int] = {}
        accept = [-1]
        for i in ids:
            at = 0
            for b in self.bytes_of[i]:
                at = nodes.setdefault(at << 8 | b, len(accept))
                if at == len(accept):
                    accept.append(-1)
            accept[at] = i
        self.steps, self.step, self.accept = nodes, IntMap(list(nodes), list(nodes.values())), np.array(accept, np.int32)

    def _own(self) -> None:
        """Which tokens encode to themselves: both halves do and nothing merges across before."""
        self.own = np.zeros(self.size, bool)
        self.own[self.byte_id] = True
        made = np.flatnonzero(self.born >= 0)
        made = made[np.argsort(self.born[made])]
        clear = self.compatible(self.left[made], self.right[made], self.born[made])
        for i, ok in zip(made.tolist(), clear.tolist(), strict=True):
            self.own[i] = ok and self.own[self.left[i]] and self.own[self.right[i]]

    def compatible(self, a, b, limit=None):
        """For each pair of self-encoding tokens: does the border between them survive?

        Going back in time, whichever of the two facing tokens was made later gives way to its
        half at the border. The border falls if two tokens that face each other at some time form
        a merge due before either is absorbed (on a tie the leftmost pair merges first).
        """
        x, y = np.asarray(a, np.int32).copy(), np.asarray(b, np.int32).copy()
        x_ends = np.full(len(x), NEVER) if limit is None else np.asarray(limit, np.int32).copy()
        y_ends = x_ends - 1 if limit is not None else x_ends.copy()
        ok, todo = np.ones(len(x), bool), np.arange(len(x))
        while len(todo):
            rank = self.rank_of_pair.find(x[todo].astype(np.int64) * self.size + y[todo])
            falls = (rank >= 0) & (rank < x_ends[todo]) & (rank <= y_ends[todo])
            ok[todo[falls]] = False
            todo = todo[~falls]
            bx, by = self.born[x[todo]], self.born[y[todo]]
            todo, bx, by = (v[(bx >= 0) | (by >= 0)] for v in (todo, bx, by))
            go = bx > by
            i, j = todo[go], todo[~go]
            x_ends[i], x[i] = bx[go], self.right[x[i]]
            y_ends[j], y[j] = by[~go], self.left[y[j]]
        return ok

    def exact(self, word: bytes) -> list[int]:
        """Merge lowest rank first, leftmost on ties."""
        ids = [self.byte_list[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*self.merge[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (p := (made, ids[after[i]])) in self.merge:
                    heapq.heappush(heap, (*self.merge[p], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], made)) in self.merge:
                heapq.heappush(heap, (*self.merge[p], before[i], *p))
        return [i for i in ids if i >= 0]

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """As ``exact``, for many words at once: each round merges every word's lowest rank.

        With ranks that rise from parts to wholes, equal pairs of a word may merge together.
        """
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranks(i):
            j = np.minimum(i + 1, len(ids) - 1)
            r = self.rank_of_pair.find(ids[i].astype(np.int64) * self.size + ids[j])
            return np.where((r >= 0) & (word[i] == word[j]) & (i != j), r, NEVER)

        rank = ranks(np.arange(len(ids)))
        while len(ids):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(ids)))
            if (low == NEVER).any():
                stay = np.repeat(low != NEVER, length)
                done.append((word[~stay], ids[~stay]))
                ids, word, rank = ids[stay], word[stay], rank[stay]
                length, low = length[low != NEVER], low[low != NEVER]
                if not len(ids):
                    break
            i = np.flatnonzero(rank == np.repeat(low, length))
            # of hits side by side every second one merges, from the left
            new_run = np.diff(i, prepend=-2) != 1
            i = i[(np.arange(len(i)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]) % 2 == 0]
            ids[i] = self.made[rank[i]]
            keep = np.ones(len(ids), bool)
            keep[i + 1] = False
            at = np.cumsum(keep)[i] - 1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = ranks(touched)
        owner, token = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        token = token[order].tolist()
        return [token[a:b] for a, b in zip([0, *ends], ends)]

    def _greedy_one(self, word: bytes) -> list[int]:
        out, at = [], 0
        while at < len(word):
            node, end, best = 0, at, at
            while end < len(word) and (node := self.steps.get(node << 8 | word[end], -1)) >= 0:
                end += 1
                if self.accept[node] >= 0:
                    best, token = end, int(self.accept[node])
            out.append(token)
            at = best
        return out

    def _greedy(self, flat, starts, ends):
        """Longest matches of many words at once: (word, token) arrays in order of words."""
        who, token = [], []
        word = np.arange(len(starts))
        at, node = starts.copy(), np.zeros(len(starts), np.int64)
        best, best_token = starts.copy(), np.full(len(starts), -1, np.int32)
        while len(word):
            end = at >= ends
            step = self.step.find(np.where(end, 0, node << 8 | flat[np.where(end, 0, at)]))
            stuck = end | (step < 0)
            who.append(word[stuck])
            token.append(best_token[stuck])
            node = np.where(stuck, 0, step)
            at = np.where(stuck, best, at + 1)
            got = ~stuck & (self.accept[node] >= 0)
            best = np.where(got, at, best)
            best_token = np.where(got, self.accept[node], best_token)
            more = ~(stuck & (at >= ends))
            if not more.all():
                word, at, node, best, best_token, ends = (v[more] for v in (word, at, node, best, best_token, ends))
        who, token = np.concatenate(who), np.concatenate(token)
        order = np.argsort(who, kind="stable")
        return who[order], token[order]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each (non-empty) pre-token."""
        out: list = [None] * len(words)
        if not self.ordered:
            return [self.exact(w) for w in words]
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        flat = np.frombuffer(b"".join(words[k] for k in short), np.uint8).astype(np.int64)
        ends = np.cumsum([len(words[k]) for k in short], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if short:
            who, token = self._greedy(flat, starts, ends)
        else:
            who, token = np.zeros(0, np.int64), np.zeros(0, np.int32)
        who = np.asarray(short, np.int64)[who] if short else who
        for k, w in enumerate(words):
            if len(w) > LONG:
                t = self._greedy_one(w)
                who, token = np.concatenate([who, np.full(len(t), k)]), np.concatenate([token, np.array(t, np.int32)])
        pair = np.flatnonzero(who[1:] == who[:-1])
        keys, back = np.unique(token[pair].astype(np.int64) * self.size + token[pair + 1], return_inverse=True)
        fine = self.compatible(keys // self.size, keys % self.size)[back]
        failed = np.zeros(len(words), bool)
        failed[who[pair[~fine]]] = True
        failed[who[~self.own[token]]] = True
        counts = np.bincount(who, minlength=len(words))
        first = np.zeros(len(words), np.int64)
        edge = np.flatnonzero(np.diff(who, prepend=-1) != 0)
        first[who[edge]] = edge
        ids = token.tolist()
        for k, (f, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
            out[k] = ids[f : f + n]
        failed = np.flatnonzero(failed).tolist()
        some = [k for k in failed if len(words[k]) <= LONG]
        for k, merged in zip(some, self.exact_many([words[k] for k in some]) if some else (), strict=True):
            out[k] = merged
        for k in failed:
            if len(words[k]) > LONG:
                out[k] = self.exact(words[k])
        return out

    def _learn(self, pieces: list[list[str]]) -> None:
        new = set().union(*pieces).difference(self.words)
        size = lambda some: sum(map(len, some)) * 4 + ENTRY * len(some)
        self.held += size(new)
        if self.held > CACHE:
            self.forget()
            new = set().union(*pieces)
            self.held = size(new)
        if not new:
            return
        new = list(new)
        for w, ids in zip(new, self.encode_words([w.encode() for w in new]), strict=True):
            self.words[w] = ",".join(map(str, ids))
            self.plain[w] = self.decode_bytes(ids)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _pieces(self, text: str) -> list[str]:
        if self.split_special is None or not self.split_special.search(text):
            return self.find(text)
        out = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                self.words[part], self.plain[part] = str(self.special[part]), part.encode()
                out.append(part)
            else:
                out += self.find(part)
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        joined = self.encode_joined([text])[0][0]
        return [int(i) for i in joined.split(",")] if joined else []

    def forget(self) -> None:
        """Drop the words remembered."""
        self.words.clear()
        self.plain.clear()
        self.held = 0

    def encode_joined(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and the bytes they decode to."""
        pieces = [self._pieces(t) for t in texts]
        self._learn(pieces)
        for special, i in self.special.items():  # _learn may have emptied the cache
            self.words[special], self.plain[special] = str(i), special.encode()
        ids, plain = self.words.__getitem__, self.plain.__getitem__
        return [(",".join(map(ids, p)), b"".join(map(plain, p))) for p in pieces]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def some_at_a_time(texts: list[str], most: int = 1 << 22):
    """Runs of texts of about ``most`` characters in all, at least one each."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[first:k]
            first, size = k, 0
        size += len(t)
    if texts:
        yield texts[first:]


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts; null and empty texts have no tokens and the digests of empty strings. Special
    tokens' strings inside a text become those tokens. Rows are independent, so repeated rows give
    repeated results, a lost executor costs its partitions alone and an empty table stays empty.
    Ids may be null. ``path`` names a tokenizers file that every executor has.
    """

    def run(batches):
        bpe = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids, decoded = [], [], []
            for texts in some_at_a_time(batch.column(1).to_pylist()):
                for joined, plain in bpe.encode_joined(texts):
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(sha(joined.encode()))
                    decoded.append(sha(plain.decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(tidy(run, lambda: load(path).forget()), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``token_ids`` (array of int) in place of any column of that name."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    rest = docs.drop("token_ids")
    where = rest.columns.index(text_col)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids = []
            for texts in some_at_a_time([t or "" for t in batch.column(where).to_pylist()]):
                ids += [np.array(j.split(",") if j else [], np.int32) for j, _ in bpe.encode_joined(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "token_ids"])

    return rest.mapInArrow(tidy(run, lambda: load(path).forget()), StructType([*rest.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))
