"""Lexical search, importance resampling and SimHash dedup against plain Python, on texts that hold the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalith.llm import importance_resampling, lexical_search, simhash_dedup

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sample():
    r = random.Random(5)
    common, rare = "the of And stone river über ÉNORME don't naïve 3.5".split(), [f"w{i}" for i in range(150)]
    texts = [" ".join(r.choice(common if r.random() < 0.6 else rare) for _ in range(r.randint(0, 60))) for _ in range(90)]
    for i in range(0, 80, 9):
        texts[i + 5] = texts[i]  # ties
    texts[3], texts[4], texts[8] = None, "", " \n\t-- ,"
    texts[9] = "stone river " * 700 + "end"  # longer than a chunk
    texts[11] = "x" * 5000
    texts[12] = " " * 4000
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (rows[21][0], "another river text of w7 w8"), (None, "river of w1 w2"), (None, texts[30])]


ITEMS = [(1, "the STONE w3 w4, w4 w5 river"), (2, ""), (3, None), (4, "nothingofthis"), (5, "über énorme the of and"), (6, "w7 w8 w9 w10 w11 w12 w13 river the"), (None, "w1 w2 river"), (6, "naïve")]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with the operators' own
    return spark.createDataFrame([(i, t, 7, "z", 1) for i, t in sample()], "doc_id long, text string, row int, term string, score int").repartition(4)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def searched(docs, items, best):
    terms = [Counter(WORD.findall(folded(t))) for _, t in docs]
    n, df = [sum(c.values()) for c in terms], Counter(t for c in terms for t in c)
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    out = []
    for item, text in items:
        found = []
        for k, c in enumerate(terms):
            m = 10 + 90 * n[k] * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(WORD.findall(folded(text))) if t in c)
            if s > 0:
                found.append((-s, docs[k][0] is None, docs[k][0] or 0, docs[k][0]))
        out += [(item, place, f[3], -f[0]) for place, f in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("best", [1, 3, 10, 500])
def test_search(spark, docs, best):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = lexical_search.search(docs, items, best)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == searched(sample(), ITEMS, best)


def test_search_with_a_full_filter_and_with_nothing(spark, docs):
    index = lexical_search.Index(docs, None, 2)
    assert index.weights.count() == len({t for _, x in sample() for t in WORD.findall(folded(x))})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(empty(spark), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lexical_search.search(docs, items, 0)


def test_search_prunes(spark):
    """A document that holds a common word alone is no candidate, and the result stays what it is."""
    r = random.Random(2)
    rows = [(i, "common " + " ".join(f"w{r.randrange(400)}" for _ in range(30))) for i in range(400)] + [(1000 + i, f"common key extra{i} words here") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "common key words here")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == searched(rows, items, 10)


def drawn(docs, target, n, buckets, percent, least_words):
    def features(text):
        w = [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded(text))]
        return len(w), Counter(zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))

    mine, aim = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = (sum((f for _, f in x), Counter()) for x in (mine, aim))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (doc_id, _), (words, f) in zip(docs, mine, strict=True):
        k = sum(f.values())
        weight = sum(gain[b] * c for b, c in f.items()) // k if k else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, k, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i for i, r in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("n, chunk", [(1, 1 << 20), (1, 64), (3, 100), (4, 1)])
def test_resampling(spark, docs, n, chunk):
    target = [t for _, t in ITEMS]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance_resampling.resampled(docs, frame, n, 97, 40, 5, chunk=chunk)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # rows of one doc_id and score may take each other's places
    assert sorted(map(tuple, got.collect()), key=str) == drawn(sample(), target, n, 97, 40, 5)


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance_resampling.resampled(empty(spark), none).count() == 0
    got = importance_resampling.resampled(docs, none, buckets=50, percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))


def test_chunks_own_their_words():
    words = [f"w{i}".encode() for i in range(200)] + [b"y" * 90]
    for most in (1, 7, 50, 5000):
        for carried in (0, 2):
            parts = list(importance_resampling.chunks(b"  " + b" ".join(words) + b" ", carried, most))
            assert [w for body, _ in parts for w in body.split()] == words
            at = 0
            for body, carry in parts:
                at += len(body.split())
                assert carry.split() == words[at : at + carried]


def plain_fingerprint(text):
    w = folded(text).encode().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """(doc_id, fingerprint) to the smallest doc_id that links of at most three bits reach."""
    code = [f for _, f in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (code[i] ^ code[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, f"{f:016x}", least.get(top(i))) for i, (d, f) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell", [8, 1 << 14])
def test_simhash(spark, docs, cell):
    r = random.Random(3)
    near = []
    base = [f"v{r.randrange(300)}" for _ in range(250)]
    for i in range(60):  # edited copies
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = "changed"
        near.append((5000 + i, " ".join(w)))
    rows = sample() + near
    both = docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(*x, 1) for x in near], "doc_id long, text string, row int"))
    got = simhash_dedup.simhash_dedup(both, cell=cell).collect()
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted(((x["doc_id"], x["fingerprint"], x["component_id"]) for x in got), key=str) == want
    assert all(x["kept"] == (x["doc_id"] is not None and x["doc_id"] == x["component_id"]) for x in got)
    assert simhash_dedup.simhash_dedup(empty(spark)).count() == 0


def test_simhash_of_a_long_text():
    words = [f"w{i % 70_001}" for i in range(simhash_dedup.PIECE + 5)]
    assert int(simhash_dedup.fingerprints([" ".join(words).encode()], 3)[0]) == plain_fingerprint(" ".join(words))


@pytest.mark.parametrize("cell, most", [(20, 40), (1 << 14, 4)])
def test_cells_join_all_near_codes(spark, cell, most):
    """Codes of one crowd, most of them in the same cells, which are split several times."""
    r = np.random.default_rng(4)
    crowd = np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << r.integers(0, 64, (900, 3), np.uint64)).sum(axis=1, dtype=np.uint64)
    codes = np.unique(np.concatenate((crowd, r.integers(0, 2**64, 600, np.uint64))))
    entries = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = simhash_dedup.links_of(simhash_dedup.cells(entries, cell), 3, least_rows=50).collect()
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    found, want = np.arange(len(codes)), np.arange(len(codes))
    if links:
        simhash_dedup.joined(found, *(np.array([place[x[k]] for x in links]) for k in ("a", "b")))
    simhash_dedup.joined(want, *np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3))
    assert (found == want).all() and len(links) < most * len(codes)
