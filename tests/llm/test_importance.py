"""Importance resampling against a plain version, whatever the texts hold and however they are cut."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wirelake.llm import importance

from test_llm import docs_of, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target):
    s, t, rows = Counter(), Counter(), []
    for text in target:
        t.update(plain_features(text)[1])
    found = [(i, *plain_features(x)) for i, x in docs]
    for _, _, f in found:
        s.update(f)
    ratio = lambda b: (t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000))
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log(ratio(b))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(order[: 5 * len(order) // 100])}
    return sorted(((r[0], *r[2:], drawn.get(id(r))) for r in rows), key=str)


TARGET = ["changed words of a passage", "日 a b c d", None, "", "One two THREE one two"]


def result(docs, target):
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    out = importance.importance_resample(docs, target)
    assert out.columns == cols
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_against_plain(spark):
    texts = odd_texts() * 9 + ["Ä" * 70000, "ab " * 5000, "x" * 30 + "\x7f\x00y\x85z  w"]
    docs, target = docs_of(spark, texts), spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id bigint, text string")
    want = plain(list(enumerate(texts)), TARGET)
    assert result(docs, target) == want
    assert sum(r[4] is not None for r in want) >= 5
    few = docs.filter("doc_id < 30")
    assert result(few, target.limit(0)) == plain(list(enumerate(texts[:30])), [])
    assert result(docs.limit(0), target) == []


def test_odd_ids(spark):
    texts = odd_texts()
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[12]), (None, texts[-1])]
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = result(spark.createDataFrame(rows, "doc_id bigint, text string"), target)
    drop = lambda some: sorted((r[:4] for r in some), key=str)
    assert drop(got) == drop(plain(rows, TARGET))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 5 * sum(plain_features(t)[0] >= 20 for _, t in rows) // 100 + 1))


@pytest.mark.parametrize("stretch", [1, 7, 100])
def test_cut_texts(stretch, monkeypatch):
    """However small the parts of a text, each feature counts once."""
    monkeypatch.setattr(importance, "STRETCH", stretch)
    texts = [(t or "").encode() for t in odd_texts()]
    words, counts = importance.Words(), [Counter() for _ in texts]
    for parts in importance.stretches(enumerate(texts)):
        for crc, count, node, row in importance.levels(words, parts):
            assert (np.bincount(node, minlength=len(crc)) == count).all()
            for n, r in zip(node.tolist(), row.tolist(), strict=True):
                counts[r][int(crc[n]) % 10000] += 1
    assert counts == [Counter(plain_features(t)[1]) for t in odd_texts()]


def test_drawn_documents(spark):
    docs = docs_of(spark, [f"word{i} " * 30 for i in range(100)])
    target = spark.createDataFrame([("word7 word7 word7",)], "text string")
    drawn = importance.drawn_documents(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == 5
