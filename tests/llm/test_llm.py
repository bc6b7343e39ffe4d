"""Each operator against a plain version on small tables, and on the odd rows a corpus has."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wirelake.llm import ann, byte_bpe, exact_dedup, lm, mixing, ngram_join, quality, rindex, suffix_dedup, token_count, toxicity

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
EXTRA = {"keep_id": 1, "score": "x", "h": 2, "id": "y", "held_out": True, "__id": 3}


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    near = [b.replace(b.split()[30], "changed") for b in base]
    return [None, "", " ", "\t\n ", "one", "one  two", "one\ttwo", "a b c d", "<|endoftext|> x<s>", "x" * 3000, "é " * 900, *base, *near, base[0], base[0].upper(), base[1] + "\n" + base[2], " ".join(base) * 4]


def docs_of(spark, texts, first=0, extra=True):
    rows = [(first + i, t, f"s{i % 3}" if i % 5 else None, *EXTRA.values()) for i, t in enumerate(texts)]
    ddl = "doc_id bigint, text string, source string, keep_id int, score string, h int, id string, held_out boolean, __id int"
    df = spark.createDataFrame(rows, ddl)
    return df if extra else df.select("doc_id", "text", "source")


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_texts()).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "exact": lambda d, s: exact_dedup.exact_dedup(d),
    "mix": lambda d, s: mixing.mix_sources(d),
    "count": lambda d, s: token_count.token_counts(d, PIECES),
    "bpe": lambda d, s: byte_bpe.bpe_digests(d, BYTES),
    "near": lambda d, s: ngram_join.ngram_join(d),
    "suffix": lambda d, s: suffix_dedup.suffix_dedup(d),
    "lm": lambda d, s: lm.lm_scores(d),
    "quality": lambda d, s: quality.quality_scores(d, s),
    "toxic": lambda d, s: toxicity.toxicity_scores(d, s),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, labels, spark):
    """A row per document whatever it holds, no crash on an empty table, the same on a rerun."""
    got = OPERATORS[name](odd, labels).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.doc_id) == list(range(len(odd_texts()))) and not got.drop(columns=["doc_id"]).isna().any().any()
    again = OPERATORS[name](odd, labels).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(again)
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows(name, odd, labels):
    twice = odd.unionByName(odd.filter("doc_id % 2 = 0"))
    assert OPERATORS[name](twice, labels).count() == twice.count()


def plain_normal(t):
    out, gap = [], False
    for c in t or "":
        if c in " \t\n\x0b\x0c\r":
            if not gap:
                out.append(" ")
            gap = True
        else:
            out.append(c)
            gap = False
    return "".join(out)


@pytest.mark.parametrize("hasher", [exact_dedup.content_hash, lambda t: F.lit(b"same")])
def test_exact_dedup(odd, hasher):
    """Also where every hash collides: bytes decide."""
    groups = defaultdict(list)
    for i, t in enumerate(odd_texts()):
        groups[plain_normal(t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd, hasher=hasher).collect()}
    assert got == want
    assert {r.doc_id for r in exact_dedup.drop_copies(odd).collect()} == {i for i, w in want.items() if w[2]}


def test_exact_dedup_never_merges_silently(odd):
    with pytest.raises(Exception, match="share hash"):
        exact_dedup.exact_dedup(odd, hasher=lambda t: F.lit(b"same"), digest=lambda t: F.lit("same")).collect()


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = {f"s{k:02}": rng.choice([0, 5, 50, 500, 5000, 50000]) for k in range(9)} | {None: 77}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        names = sorted(k for k in sizes if k) + [None]
        weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
        left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
        while open_:  # cap whoever is above, share the rest again
            level = left / sum(weight[n] for n in open_)
            above = {n for n in open_ if level * weight[n] > 2 * sizes[n]}
            for n in above or open_:
                target[n] = 2 * sizes[n] if above else level * weight[n]
            left -= sum(target[n] for n in above)
            open_ = open_ - above if above else set()
        assert got == pytest.approx(target)


def test_mix(spark):
    rng = random.Random(2)
    texts = [" ".join("w" for _ in range(rng.randint(0, 40))) for _ in range(900)]
    df = spark.createDataFrame([(i, t, "hot" if i % 3 == 0 else f"s{i % 7}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rows = mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").collect()
    assert all(r.size == len(texts[r.doc_id].split()) and r.taken in (0, r.size, 2 * r.size) for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 45 and mine[0].source_size == sum(r.size for r in mine)
    copies = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert copies == {r.doc_id: r.copies for r in rows if r.copies}


def unusual_strings(n, seed):
    rng = random.Random(seed)
    mild = "ab the  \n\t'sé日😀1.,$ \x1c\x85▁" + " "
    wild = lambda: chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x3041, 0x9FFF), rng.randint(0x1F300, 0x1F5FF)]))
    return ["".join(rng.choice(mild) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["".join(wild() for _ in range(20)) for _ in range(n)] + ["ab" * 2000, " " * 999, "x" * 1500 + " y", "<|endoftext|>a<|endoftext|>", "it's we'll"]


def test_token_counts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = unusual_strings(400, 3) + [t or "" for t in odd_texts()]
    counter = token_count.PieceCounter(PIECES)
    assert counter.count(texts) == [len(x) for x in model.encode(texts)]
    assert all(counter.exact(w) == n for w, n in list(counter.counts.items())[:500])


def test_byte_bpe():
    library, mine = Tokenizer.from_file(BYTES), byte_bpe.ByteBpe(BYTES)
    texts = unusual_strings(400, 4) + [t or "" for t in odd_texts()]
    for t, (joined, plain), want in zip(texts, mine.encode_joined(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert joined == ",".join(map(str, want.ids)) and plain.decode("utf-8", "replace") == t == mine.decode(mine.encode(t))
    half = mine.encode("é")[:1]
    assert mine.decode(half) == library.decode(half, skip_special_tokens=False)


def test_encode_documents(odd):
    rows = byte_bpe.encode_documents(odd.withColumn("token_ids", F.lit("clash")), BYTES).collect()
    mine = byte_bpe.load(BYTES)
    assert all(mine.decode(r.token_ids) == (r.text or "") for r in rows)


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


@pytest.mark.parametrize("block,grams", [(1024, 1_000_000), (3, 1_000_000), (1024, 300)])
def test_ngram_join(spark, block, grams):
    """Links and classes of all pairs; small blocks force groups to be compared in pieces."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(rng.randint(80, 150))] for _ in range(8)]
    texts = odd_texts()
    for b in base:
        for _ in range(rng.randint(1, 9)):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    links, root = Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs_of(spark, texts), block=block, grams=grams).collect()}
    assert got == {i: (find(i), links[i]) for i in range(len(texts))}
    assert {r.doc_id for r in ngram_join.drop_near_copies(docs_of(spark, texts), block=block, grams=grams).collect()} == {i for i in range(len(texts)) if find(i) == i}


def test_ngram_join_with_null_and_reused_ids(spark):
    """Texts that share an id are documents of their own; equal rows are copies."""
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, word(1)), (1, word(2)), (3, word(2) + " more"), (None, word(3)), (4, word(3) + " more"), (5, word(5)), (5, word(5)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 9, r.copy_of or 9, r.class_id or 9, r.n_links) for r in ngram_join.ngram_join(docs).collect()))
    assert got == sorted([(1, 1, 1, 0), (1, 1, 1, 1), (3, 3, 1, 1), (9, 9, 4, 1), (4, 4, 4, 1), (5, 5, 5, 1), (5, 5, 5, 1), (9, 9, 9, 0)])
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    assert sorted(r.n_links for r in ngram_join.ngram_join(named).collect()) == sorted(r[3] for r in got)


def test_ngram_join_of_long_texts(spark):
    """A group of long texts is compared in blocks bounded by their n-grams."""
    rng = random.Random(19)
    base = [rng.randrange(50_000) for _ in range(20_000)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 500)):
            w[rng.randrange(len(w))] = -1
        texts.append(" ".join(map(str, w)))
    sets = [shingles(t) for t in texts]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_join(docs_of(spark, texts, extra=False), grams=100_000).collect()}
    assert got == dict(enumerate(want))


def test_ties():
    """No two rows that differ in few enough places are parted; far ones are not chained."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (40, 200)).astype(np.uint8).repeat(6, 0)
    for r in rows:
        r[rng.choice(200, rng.integers(0, 45), replace=False)] = rng.integers(0, 256)
    root = ngram_join.ties(rows, 0.33)
    apart = (rows[:, None] != rows[None]).mean(2)
    assert (root[:, None] == root[None])[apart <= 0.33].all() and len(set(root.tolist())) >= 40


def test_bands():
    b, r = ngram_join.choose_bands()
    assert b * r <= ngram_join.MOST_HASHES and 1 - (1 - 0.8**r) ** b >= 0.999


def test_run_length_index():
    rng = random.Random(2)
    for trial in range(120):
        depth, letters = rng.choice([3, 5, 8, 13, 20]), "ab" if trial % 2 else "abcdefgh"
        strings = ["".join(rng.choice(letters) for _ in range(rng.randint(depth, depth * 3))).encode() for _ in range(rng.randint(1, 12))]
        index, seen = rindex.RunLengthIndex(strings, depth), set()
        for s, flags in zip(strings, index.earlier([len(s) - depth + 1 for s in strings]), strict=True):
            for i, f in enumerate(flags):
                assert f == (s[i : i + depth] in seen)
                seen.add(s[i : i + depth])


def plain_suffix(texts, depth=100):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, in order."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - depth + 1):
            if raw[p : p + depth] in seen:
                gone[p : p + depth] = True
            seen.add(raw[p : p + depth])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def suffix_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("group,often", [(400, 64), (2, 64), (3, 1)])
def test_suffix_dedup(spark, group, often):
    """Byte for byte; tiny sizes send anchors through all levels."""
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdefg hij é") for _ in range(n))
    shared = [line(n) for n in (90, 100, 101, 130, 400)]
    texts = odd_texts() + ["".join(rng.choice([line(40), rng.choice(shared)]) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [shared[4] * 3, "ab" * 200]
    got = suffix_rows(suffix_dedup.suffix_dedup(docs_of(spark, texts), group=group, often=often))
    assert got == dict(enumerate(plain_suffix(texts)))


def test_suffix_dedup_with_a_very_common_anchor(spark):
    """10,000 different contexts of one phrase, some of them again in part."""
    rng = random.Random(14)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase = line(64)
    texts = [line(60) + phrase + line(60) for _ in range(10_000)]
    texts += [line(30) + rng.choice(texts)[rng.randint(0, 40) :] for _ in range(300)]
    got = suffix_rows(suffix_dedup.suffix_dedup(docs_of(spark, texts, extra=False)))
    assert got == dict(enumerate(plain_suffix(texts)))


def test_suffix_dedup_with_null_and_reused_ids(spark):
    """Rows of one id and text are one document; texts that share an id are not."""
    rng = random.Random(15)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b = line(300), line(300)
    texts = sorted([line(50) + b, a + line(40), b], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = [(1, a), (1, a), *((2, t) for t in texts), (None, b + a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_suffix([a, *texts, b + a])
    got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == sorted([(1, *want[0]), (1, *want[0]), *((2, *w) for w in want[1:4]), (9, *want[4]), (9, 0, 0, 0, hashlib.sha256(b"").hexdigest())])


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).round(1)
    x[100:140] = x[100]  # copies tie
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0]), (2500, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1)).withColumn("list", F.lit("clash"))
    found, right, total = defaultdict(list), 0, 0
    for r in ann.nearest_neighbours(df).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 100))
    for q, hits in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11)) and all(h[2] == pytest.approx(d[h[1]], abs=1e-12) for h in hits)
        assert [(s, i) for _, i, s in hits] == sorted((s, i) for _, i, s in hits)
        right, total = right + len({h[1] for h in hits} & set(order)), total + 10
    assert right / total >= 0.9
    assert [h[1] for h in found[100]] == list(range(101, 111))
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.filter("vec_id in (0, 1, 2)")).count() == 2


def test_lists_read_on_clusters():
    """Few lists hold nearly all true neighbours where vectors have clusters; none reads too few."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 32))[rng.integers(0, 300, 20_000)] + rng.normal(size=(20_000, 32)) * 0.25
    graph = ann.CentroidGraph(ann.balanced_centroids(x, 100))
    graph.tune(x, 10)
    homes = [h for i in range(0, len(x), 256) for h in graph.borders(x[i : i + 256])]
    sizes = np.bincount(np.concatenate(homes), minlength=len(graph.c))
    asked = np.arange(0, len(x), 100)
    read = graph.lists(x[asked], sizes, 10)
    far = (x[asked] ** 2).sum(1)[:, None] - 2 * x[asked] @ x.T + (x**2).sum(1)[None]
    far[np.arange(len(asked)), asked] = np.inf
    found = [bool(np.isin(homes[v], read[i]).any()) for i, row in enumerate(np.argpartition(far, 10, 1)[:, :10]) for v in row]
    assert np.mean(found) >= 0.9 and np.mean([len(r) for r in read]) < 0.2 * len(graph.c)
    few = graph.lists(x[asked], np.ones(len(graph.c), int), 10)
    assert min(len(r) for r in few) >= 10


def test_nearest_with_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [0.0, 1.5]), (8, [3.0, 0.0]), (8, [3.0, 0.0]), (None, [1.0, 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()]
    assert sorted(got) == [(0, 1, 7, 0.5), (0, 2, 8, 2.0)]


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def held_out(rows, folds, fold):
    return [zlib.crc32(str(r.doc_id).encode()) % folds == fold for r in rows]


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."
    bad = [lambda: "Buy!!! " * 50, lambda: good().upper() + " !!", lambda: " | ".join(good().split()), lambda: " ".join(w + rng.choice("$%&#") for w in good().split())]
    y = [int(rng.random() < 0.7) for _ in range(600)]
    texts = [good() if v else rng.choice(bad)() for v in y]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id bigint, quality int")
    rows = quality.quality_scores(docs, labels).orderBy("doc_id").collect()
    assert [r.held_out for r in rows] == held_out(rows, 5, 0) and all(r.predicted == (r.score >= 0.3) for r in rows)
    test = np.array([r.held_out for r in rows])
    assert auc(np.array([r.score for r in rows])[test], np.array(y)[test]) > 0.97
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {r.doc_id for r in rows if r.predicted}


def test_forest_walk():
    """The flat arrays give what a recursive walk gives."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    forest = quality.Forest.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), least=3)

    def leaf(i, row):
        while forest.left[i] != i:
            i = forest.left[i] if row[forest.feature[i]] <= forest.cut[i] else forest.right[i]
        return forest.value[i]

    plain = [1 / (1 + math.exp(-(forest.base + sum(leaf(r, row) for r in forest.roots)))) for row in x[:50]]
    assert forest.score(x[:50]) == pytest.approx(plain) and auc(forest.score(x), (x[:, 0] * x[:, 1] > 0).astype(int)) > 0.95


def test_toxicity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(800)]
    rude = ["grobian", "lumpenhund", "schwindler"]
    y = [int(rng.random() < 0.3) for _ in range(700)]
    texts = [" ".join(rng.choice(rude) if v and rng.random() < 0.04 else rng.choice(vocabulary) for _ in range(80)) for v in y]
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_scores(docs_of(spark, texts), labels).orderBy("doc_id").collect()
    assert [r.held_out for r in rows] == held_out(rows, 4, 2) and all(r.predicted == (r.score >= 0.3) for r in rows)
    test = np.array([r.held_out for r in rows])
    assert auc(np.array([r.score for r in rows])[test], np.array(y)[test]) > 0.9
    model = toxicity.train(docs_of(spark, texts), labels)
    plain = " ".join(vocabulary[:60])
    assert model.score(plain + " lumpenhumd") > model.score(plain) and model.score(plain + " lumpenhund") > 0.5


@pytest.mark.parametrize("classes,known", [(6, 20), (3, 4), (500, 5000)])
def test_lm(spark, odd, classes, known):
    """Counts, base and score of every text by plain loops over the model's tables."""
    texts = [t or "" for t in odd_texts()]
    words = [byte_split(t) + [b""] for t in texts]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(w for ws, h in zip(words, out, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    rows = lm.lm_scores(odd, classes=classes, known=known).orderBy("doc_id").collect()
    training = odd.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    model = lm.train(training, classes=classes, known=known)
    within = {bytes(r.token): r.fit for r in model.rest.collect()}
    frequent = {w: i for i, w in enumerate(model.words[: model.classes])}
    assert set(within) | set(frequent) >= set(count) and not set(within) & set(frequent)
    assert (10 ** model.table.astype(float)).sum(1) == pytest.approx(np.ones(len(model.table)), abs=1e-4)
    for g in range(len(model.unseen)):
        assert sum(10 ** (f[g]) for f in within.values()) + 10 ** model.unseen[g] == pytest.approx(1, abs=1e-4)
    for r, ws, h in zip(rows, words, out, strict=True):
        base, score, last, rest_before = 0.0, 0.0, 0, False
        for w in ws:
            g = model.cluster[last]
            context = model.classes + g if rest_before else last
            base += math.log10((count[w] + 1) / (n + v + 1))
            score += float(model.table[context, frequent.get(w, model.classes)])
            if w not in frequent:
                score += within[w][g] if w in within else model.unseen[g]
            last, rest_before = (frequent[w], False) if w in frequent else (last, True)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-5, abs=1e-4)


def byte_split(t):
    return t.encode().lower().split()


def test_lm_learns_contexts_of_rare_tokens(spark):
    """A token beyond the classes is likelier after the words that it follows."""
    rng = random.Random(12)
    names, verbs = [f"name{i}" for i in range(60)], [f"verb{i}" for i in range(60)]
    texts = [" ".join(x for _ in range(30) for x in ("the", rng.choice(names), "can", rng.choice(verbs))) for _ in range(300)]
    docs = docs_of(spark, [*texts, "the name1", "the verb1", "can verb1", "can name1"], extra=False)
    score = {r.doc_id: r.score for r in lm.lm_scores(docs, classes=3, known=50).collect()}
    assert score[300] > score[301] + 0.5 and score[302] > score[303] + 0.5


def test_lm_fits_tokens_of_any_count():
    """Fits stay finite whatever the counts, rise step by step in the objective, and near its top."""
    rng = np.random.default_rng(0)
    groups, tokens_ = 16, 500
    directions = rng.normal(0, 1, (groups, 8)) / np.sqrt(np.arange(1, 9))
    totals = rng.dirichlet(np.ones(groups)) * 2e6
    share = np.exp(-np.arange(tokens_) / 60)
    true = np.exp(rng.normal(0, 0.7, (tokens_, 8)) @ directions.T) * share[:, None]
    n = rng.poisson(true / true.sum(0) * totals).astype(float)
    n[0] = 0
    n[0, 0], n[1], n[2] = 100_000, 0, np.arange(groups) == 3
    p = (n.sum(1) + 1) / (n.sum() + tokens_)
    noise, offset = lm.NOISE * p[:, None] * totals, np.log(lm.NOISE * p)[:, None]

    def objective(s):
        return -(n * np.logaddexp(0, offset - s) + noise * np.logaddexp(0, s - offset)).sum()

    steps = {k: lm.fit_tokens(n, totals, p, directions, steps=k) for k in (0, 1, 5, 20, 300)}
    assert all(np.isfinite(s).all() and s.max() < 5 for s in steps.values())
    values = [objective(s) for s in steps.values()]
    assert values == sorted(values)
    assert values[3] - values[0] > 0.8 * (values[4] - values[0])


def test_lm_scores_are_finite_with_frequent_tokens(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = docs_of(spark, [" ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=2000)) for _ in range(40)], extra=False)
    for r in lm.lm_scores(docs, classes=20, known=200).collect():
        assert math.isfinite(r.score) and r.score > r.base_score - 0.1 * r.n_tokens


def test_lm_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a"), (3, None)], "doc_id bigint, text string")
    rows = lm.lm_scores(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("3", 1), ("3", 2), ("None", 3), ("None", 3)]


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(30, 0.1), 30)
    counts = np.array([rng.multinomial(4000, row) for row in p])
    table = lm.LogBilinear.fit(counts).table.astype(float)
    assert (10**table).sum(1) == pytest.approx(np.ones(30), abs=1e-4)
    unigram = np.log10(counts.sum(0) / counts.sum() + 1e-12)
    assert (counts * table).sum() > (counts * unigram[None]).sum()


def test_components(spark):
    from wirelake.llm.components import connected_components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(500, k) for k in range(600, 640)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_toxicity_learns_rare_words(spark):
    """A word that too few documents hold for certainty still counts, and so do its misspellings."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(400)]
    training = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rude = set(training[:60])
    texts = [t + (" lumpenhund" if i in rude else "") + (" zwxyqq" if i in training[:5] else "") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i in rude)) for i in range(400)], "doc_id bigint, toxic int")
    model, plain = toxicity.train(docs_of(spark, texts), labels), " ".join(vocabulary[:30])
    assert model.score(plain + " zwxyqq") > model.score(plain + " zwxyq") > model.score(plain)


def test_long_tokens_stay_off_the_driver(spark, monkeypatch):
    """Texts without white space: what travels with the tasks is bounded in bytes, whatever they hold,
    and scores are those of tokens that travel."""
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string").cast("binary"), 256), F.lit(300)).alias("text"))
    model = lm.train(texts.select("doc_id", "text"))
    assert model.distinct == 301 and sum(map(len, model.words)) <= lm.KNOWN * lm.LONGEST and model.words == [lm.END]
    mixed = texts.limit(40).unionByName(spark.createDataFrame([(1000 + i, f"some words of {'x' * (i % 3 * 50)} text {i % 5}") for i in range(60)], "doc_id bigint, text string"))
    monkeypatch.setattr(lm, "LONGEST", 1 << 20)
    want = {r.doc_id: r for r in lm.lm_scores(mixed).collect()}
    monkeypatch.setattr(lm, "LONGEST", 64)
    got = {r.doc_id: r for r in lm.lm_scores(mixed).collect()}
    assert all((a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens) and math.isclose(a.base_score, b.base_score, abs_tol=1e-9) for a, b in ((got[i], want[i]) for i in want))
    assert all(np.isfinite(r.score) and r.score < 0 for r in got.values())


def test_mix_is_the_plain_order_of_finish_times(spark):
    """Every document's share of the mix, from one sort of all finish times that is cut at the budget."""
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 3, 40, 200])), rng.choice(["a", "b", "b", "c", "d", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    sized = df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("bigint").alias("size"))
    spread = {r.doc_id: r.at for r in sized.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "size"), 11).alias("at")).collect()}
    by = defaultdict(list)
    for r in sized.collect():
        by[r.source].append((spread[r.doc_id], r.doc_id, r.size))
    turns, budget = [], min(1.5 * sum(r.size for r in got.values()), 2.0 * sum(r.size for r in got.values()))
    for some in by.values():
        total, served = sum(s for _, _, s in some), 0
        for _, i, size in sorted(some):
            served += size
            goal = got[i].target
            turns += [((served + e * total) / goal if goal else 0.0, i, size, e) for e in (0, 1)]
    want, spent = Counter(), 0
    for _, i, size, _ in sorted(turns):
        spent += size
        if spent <= budget:
            want[i] += size
    assert {i: r.taken for i, r in got.items()} == {i: want[i] for i in got}
