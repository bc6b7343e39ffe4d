"""Packing: pieces against the tokenizers library, plans against bounds and a plain best fit."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from test_llm import docs_of, odd_texts
from wirelake.llm import packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain_pieces(text, capacity):
    library = Tokenizer.from_file(BYTES)
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
    cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity), len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_against_library(spark, capacity):
    texts = [*odd_texts(), "a" * 9000, "<|endoftext|>" * 20]
    docs = docs_of(spark, texts)
    rows = packing.pack_documents(docs, BYTES, capacity).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == [(i, *p) for i, t in enumerate(texts) for p in plain_pieces(t, capacity)]
    n, tokens = check_sequences(rows, capacity), sum(r.length for r in rows)
    assert tokens / capacity <= n <= 1.05 * tokens / capacity + 2
    assert packing.pack_documents(docs.limit(0), BYTES, capacity).count() == 0


def test_odd_ids_and_sequences(spark):
    texts = odd_texts()
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[12]), (None, texts[-1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack_documents(docs, BYTES, 64).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length, r.ids_crc32) for r in got) == sorted((i or 0, p[0], p[2], p[3]) for i, t in rows for p in plain_pieces(t, 64))
    n = check_sequences(got, 64)
    whole = packing.packed_sequences(docs, BYTES, 64).collect()
    assert len(whole) == n and all(1 <= len(r.token_ids) <= 64 for r in whole)
    assert sum(len(r.token_ids) for r in whole) == sum(r.length for r in got)
    ends = sum(list(r.token_ids).count(2) for r in whole)
    assert ends >= len(rows)


def test_other_tokenizers_files():
    """A file that isn't plain byte-level BPE is left to its library."""
    other = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, lower case.", "", "x" * 50]
    want = [Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids for t in texts]
    assert [e.tolist() for e in packing.encoder(other)(texts)] == want


def plain_best_fit(counts):
    room = []
    for length in range(len(counts) - 1, 0, -1):
        for _ in range(counts[length]):
            k = min((k for k, f in enumerate(room) if f >= length), key=lambda k: room[k], default=None)
            if k is None:
                room.append(len(counts) - 1)
                k = len(room) - 1
            room[k] -= length
    return len(room)


def unrolled(plan, counts):
    """The sequences that a plan's intervals describe, by going through all pieces."""
    lengths = [n for n in range(len(counts) - 1, 0, -1) for _ in range(counts[n])]
    starts, out = sorted(plan.intervals), {}
    k = -1
    for rank, length in enumerate(lengths):
        while k + 1 < len(starts) and starts[k + 1][0] <= rank:
            k += 1
        a, first, each, offset = starts[k]
        out.setdefault(first + (rank - a) // each, []).append((offset + (rank - a) % each * length, length))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(8, 90), st.integers(1, 120), st.integers(0, 10**6), st.sampled_from([1, 3, 100]))
def test_plans_hold(capacity, pieces, seed, kinds):
    rng = random.Random(seed)
    some = [rng.randint(1, capacity) for _ in range(kinds)]
    counts = np.bincount([rng.choice(some) for _ in range(pieces)], minlength=capacity + 1)
    plan = packing.packing_plan(counts, (4, 9))
    found = unrolled(plan, counts)
    assert len(found) == plan.sequences and sum(map(len, found.values())) == pieces
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert plan.sequences <= max(plain_best_fit(counts) + 1, 1.06 * plain_best_fit(counts))


def test_where_best_fit_alone_fails():
    """Six of 522, 276 and 266 each, twelve of 236: nine sequences do, best fit takes eleven."""
    for n in (10, 10**9):
        counts = np.bincount([522] * 6 + [276] * 6 + [266] * 6 + [236] * 12, minlength=1025) * n
        assert packing.packing_plan(counts).sequences == 9 * n
    assert plain_best_fit(counts // 10**9 * 10) == 110


def test_configurations_are_optimal():
    """Three to a sequence where three fit; the program's value is the sum of sizes where all fit exactly."""
    size, demand = np.array([500, 300, 224]), np.array([1000, 1000, 1000])
    found = packing.configurations(size, demand, 1024)
    assert sum(n for _, n in found) == 1000 and (sum(c * n for c, n in found) == demand).all()
