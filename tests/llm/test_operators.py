"""Each operator against a brute-force version, on texts that hold the awkward cases."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import chat_formatting, decontamination, minhash_dedup, ngram_lm, packing, quality_rules, simple8b, substring_dedup, suffix_dedup, token_output, toxicity
from stratalith.llm import blocks as B
from stratalith.llm.token_ids import WordTokens, vocabulary


def sample(n=60, seed=1):
    r = random.Random(seed)
    words = [w for w in "the of and stone river über énorme a.b c, don't <|x|> 3.5 ||| naïve".split()] + [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 90))) for _ in range(n)]
    for i in range(0, n - 10, 7):
        texts[i + 5] = texts[i]  # exact copies
        w = texts[i].split()
        if w:
            w[len(w) // 2] = "changed"
            texts[i + 6] = " ".join(w)  # near copies
    texts[3], texts[4], texts[8] = None, "", "word " * 400
    texts[9] = "x" * 300
    texts[10] = "x" * 120 + " end\n\tof it"
    return [(i * 3 - 20, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    # a column whose name clashes with what the operators add
    return spark.createDataFrame([(i, t, 1, "z") for i, t in sample()], "doc_id long, text string, n_words int, id string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring_dedup(spark, docs):
    first, want = {}, set()
    for i, t in sample():
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.add((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = {tuple(r)[:4] for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == want
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_index_in_batches_equals_one_run(spark, tmp_path):
    rows = sample()
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", bits=3)
    got = set()
    for lo, hi in ((0, 20), (20, 45), (45, 60)):
        batch = spark.createDataFrame(rows[lo:hi], "doc_id long, text string")
        got |= {tuple(r)[:4] for r in substring_dedup.substring_dedup(batch, index=index, block_bytes=2000).collect()}
        if lo == 20:
            index.compact(run_bytes=50)  # small, so that the buckets split
            assert len(index.runs) == 1 and index.bits > 3
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r)[:4] for r in substring_dedup.substring_dedup(whole).collect()}
    assert got == want
    # opened again, the index knows all of it
    again = substring_dedup.FingerprintIndex(spark, index.path, bits=3)
    assert (again.runs, again.bits, len(again.batches)) == (index.runs, index.bits, 3)
    late = substring_dedup.substring_dedup(spark.createDataFrame([(999, rows[8][1])], "doc_id long, text string"), index=again, learn=False)
    assert [(r.n_words, r.n_removed) for r in late.collect()] == [(400, 400)]
    assert len(again.runs) == 2


def test_index_after_a_crash(spark, tmp_path, monkeypatch):
    rows, index = sample(), substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", bits=3)
    one, two = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[:30], rows[30:]))
    substring_dedup.substring_dedup(one, index=index)
    monkeypatch.setattr(index, "commit", lambda *a: 1 / 0)  # the run is written, but not named
    with pytest.raises(ZeroDivisionError):
        substring_dedup.substring_dedup(two, index=index)
    index = substring_dedup.FingerprintIndex(spark, index.path, bits=3)
    assert len(index.runs) == 1
    got = {tuple(r)[:4] for r in substring_dedup.substring_dedup(two, index=index).collect()}
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    assert got == {tuple(r)[:4] for r in substring_dedup.substring_dedup(whole).collect() if r.doc_id >= rows[30][0]}


def test_batches_with_null_and_repeated_ids(spark, tmp_path):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (1, "a b"), (None, None), (9, text + " more")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_words string")
    want = [(1, 2, 0), (5, 30, 0), (5, 30, 0), (9, 31, 30), (None, 0, 0), (None, 30, 30)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/i")
    for out in (substring_dedup.substring_dedup(docs), substring_dedup.in_batches(docs, index, 3)):
        assert sorted((tuple(r)[:3] for r in out.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hot,block,bits", [(1, 1500, 6), (4096, 1500, 6), (4096, 2 << 20, None)])
def test_suffix_dedup(spark, docs, hot, block, bits):
    first, want = {}, set()
    for i, t in sample():
        w = (t or "").encode()
        gone = bytearray(len(w))
        for p in range(len(w) - 49):
            if first.setdefault(w[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(w, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        want.add((i, len(w), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert {tuple(r)[:5] for r in suffix_dedup.suffix_dedup(docs, hot=hot, block_bytes=block, bits=bits).collect()} == want
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


def test_suffix_dedup_null_and_repeated_ids(spark):
    text = "".join(f"<{i}>" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (1, "a b"), (None, None), (9, text + " more")]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(text)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted([(0, n, n), (0, 0, 0), (5, n, 0), (5, n, 0), (1, 3, 0), (9, n + 5, n)])


def test_previous_factors_by_brute_force():
    r = random.Random(1)
    for _ in range(300):
        w, n = r.choice([17, 20, 24, 33, 50]), r.randint(1, 80)
        data = b"".join(bytes(r.choice(b"ab") for _ in range(5)) * 30 if r.random() < 0.5 else bytes(r.choice(b"ab") for _ in range(60)) for _ in range(r.randint(1, 5)))
        at = np.array(sorted(r.sample(range(len(data) - w + 1), min(n, len(data) - w + 1))))
        doc = np.array([r.randint(0, 6) for _ in at])
        order, common = suffix_dedup.suffix_order(data, at, doc, w)
        own = [data[i : i + w] for i in at[order]]
        assert own == sorted(own)
        share = lambda x, y: len(os.path.commonprefix([x, y]))
        assert common.tolist() == [0, *(share(x, y) for x, y in zip(own, own[1:]))]
        d = doc[order]
        want = [max((share(own[i], own[j]) for j in range(len(own)) if d[j] < d[i]), default=0) for i in range(len(own))]
        assert suffix_dedup.previous_factors(d, common).tolist() == want


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("small,tile", [(24, 1024), (1, 2)])
def test_minhash_dedup(spark, docs, small, tile, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    monkeypatch.setattr(minhash_dedup, "TILE_SHINGLES", 64 * tile)
    sets = {i: shingles(t, 3) for i, t in sample()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert {tuple(r)[:4] for r in minhash_dedup.near_duplicates(docs, 3, 85, small=small, centres=1).collect()} == want


def test_simple8b_round_trip():
    r = np.random.default_rng(5)
    for top in (1, 2, 200, 2**20, 2**40, 2**59):
        x = r.integers(0, top, 1000, np.uint64)
        x[::97] = 2**60 - 1 + top % 7  # escapes
        assert (simple8b.decode(*simple8b.encode(x)) == x).all()
    assert len(simple8b.decode(*simple8b.encode(np.zeros(0, np.uint64)))) == 0
    assert (simple8b.decode(*simple8b.encode(np.zeros(777, np.uint64))) == 0).all()


def test_chunk_slices():
    ids = np.random.default_rng(1).integers(0, 49000, 9000).astype(np.uint32)
    payload = token_output.pack_chunk([1, None], np.array([4000, 5000]), ids)
    assert (token_output.unpack_chunk(payload)[2] == ids).all()
    for a, b in ((0, 9000), (3000, 3001), (8990, 9000), (1234, 7000)):
        assert (token_output.ids_between(payload, a, b) == ids[a:b]).all()


def encoded(end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in sample()}


def test_words_encode_as_texts():
    text = "It's the end. Über-cool <|endoftext|> x<|endoftext|>y,  no break! 12.5% (ok) DON'T naïvé ...?"
    ids = WordTokens(vocabulary()).encode([text.encode()])[0].tolist()
    from tokenizers import Tokenizer

    assert ids == Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids


def test_token_output(spark, docs):
    path = B.shared_dir(spark, "t")
    token_output.write_token_ids(docs, path)
    at, want = 0, set()
    for i, ids in sorted(encoded(1).items()):
        want.add((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in token_output.read_token_ids(spark, path).collect()} == want


def test_packing(spark, docs):
    rows = packing.pack(docs, size=128).collect()
    ids = encoded(2)
    for i, want in ids.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        at = 0
        for start, length, crc, total in mine:
            assert (start, total, crc) == (at, len(want), zlib.crc32(np.array(want[at : at + length], "<u4").tobytes()))
            at += length
        assert at == len(want)
    for q in {r.sequence_id for r in rows}:
        at = 0
        for offset, length in sorted((r.offset, r.length) for r in rows if r.sequence_id == q):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(empty(spark)).count() == 0


def test_best_cuts_are_best():
    r = random.Random(3)
    for _ in range(30):
        places, at = [], 0
        for _ in range(r.randint(1, 9)):
            at += r.randint(1, 6)
            places.append(at)
        penalty = [r.choice((0, 2, 5)) for _ in places]
        got = packing.best_cuts(np.array(places), np.array(penalty), 8)

        def cost(cut):
            return sum(8 - (b - a) for a, b in zip([0, *cut], cut)) + sum(penalty[places.index(c)] for c in cut)

        options = [[p for k, p in enumerate(places[:-1]) if bits >> k & 1] + [places[-1]] for bits in range(1 << (len(places) - 1))]
        best = min(cost(c) for c in options if all(b - a <= 8 for a, b in zip([0, *c], c)))
        assert cost(got) == best


def test_lm_base_scores(spark, docs):
    import math
    from collections import Counter

    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in sample()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in ngram_lm.lm_scores(docs).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    assert ngram_lm.lm_scores(empty(spark)).count() == 0


@pytest.mark.parametrize("total,types", [(50, 20), (10**6, 2 * 10**4), (2**36, 2**30), (2**45, 2**17)])
def test_lm_bins_hold_every_ratio(total, types):
    low, bins = ngram_lm.bin_range(total, types)
    # from a single occurrence to a word that always follows
    ratios = (types + 1) / np.array([total, total / 3, max(total / 1000, 1), 2.0, 1.0])
    b = ngram_lm.binned(np.append(ratios, 0), low, bins)
    assert b[-1] == 0 and 1 <= b[:-1].min() and b.max() < bins
    assert ngram_lm.value_of(b, low)[:-1] == pytest.approx(ratios, rel=0.1)


def test_toxicity_finds_the_lexicon(spark):
    r = random.Random(2)
    plain = lambda: " ".join(f"w{r.randint(0, 300)}" for _ in range(40))
    rows = [(i, plain() + (" you idiot moron" if i % 5 == 0 else "")) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i in range(300)) and got[900].predicted == got[901].predicted == 0
    assert {x.score for x in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {toxicity.PRIOR}


def test_decontamination(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randint(0, 3000)}"
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    edited = items[1].split()
    edited[5], edited[20] = "other", "words"
    texts = {1: "a b c " + items[0].upper() + " d e", 2: " ".join(edited), 3: " ".join(word() for _ in range(300)), 4: None, 5: "", 6: "short item"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()} == {(1, 0), (2, 1)}
    short = spark.createDataFrame([(7, "Short item.")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, short).collect()} == {(6, 7)}
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def aligned(a, b):
    """Best Smith-Waterman score of two lists of words: 2 for a match, -1 for all else."""
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, new[j] - 1))
        h, best = new, max(best, max(new))
    return best


@pytest.mark.parametrize("elsewhere", [0, 6])
def test_decontamination_of_edited_copies(spark, elsewhere):
    r = random.Random(9)
    word = lambda: r.choice(("the", "of", "and", "in")) if r.random() < 0.3 else f"w{r.randint(0, 400)}"
    plain = lambda n: [word() for _ in range(n)]
    items = {i: plain(n) for i, n in enumerate((15, 20, 24, 30, 38, 45, 59, 90))}
    texts = []
    for w in items.values():
        half = len(w) // 2 + 1
        for part in (w[:half], w[-half:]):
            texts.append(part)
        for share in (10, 15, 20, 25):
            texts.append([f"x{r.randint(0, 9)}" if r.randint(0, 99) < share else x for x in w])
            texts.append([y for x in w for y in ((x, "so") if r.randint(0, 99) < share else (x,))])
        texts.append([y for k, x in enumerate(w) for y in ((x, "so") if k % 3 == 2 else (x,))])
        texts.append([x if k % 14 not in (4, 7, 10, 13) else "other" for k, x in enumerate(w)])
        # what an item keeps may be common, or rarer than what an edited copy lacks
        texts += [w] * elsewhere + [w[i : i + 5] for i in range(0, len(w), 4) for _ in range(elsewhere)]
    texts = [plain(r.randint(0, 60)) + t + plain(r.randint(0, 60)) for t in texts] + [plain(200) for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    want = {(d, i): s / (2 * len(w)) for d, t in enumerate(texts) for i, w in items.items() if (s := aligned(w, t)) >= min(len(w), 30)}
    got = {(x.doc_id, x.item_id): x.similarity for x in decontamination.leaks(docs, bench).collect()}
    assert len(want) > 80 and got == pytest.approx(want)


def compare(df, sql, **tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t.toPandas())
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_quality_rules(spark, docs):
    compare(quality_rules.line_first_cleaning(docs).select(*quality_rules.COLUMNS), quality_rules.OP2_SQL, documents=docs.select("doc_id", "text"))
    good = "A plain sentence stands here.\n" + "\n".join(f"Number {i} says something new about thing {i * 7}." for i in range(9))
    bad = "home | about | contact | search\n" * 8 + "One good line."
    rows = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    assert {(r.doc_id, r.kept) for r in quality_rules.line_first_cleaning(rows).collect()} == {(1, True), (2, False)}


def test_chat_formatting(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 5, "user", "other"), (5, 7, "user", "other"), (6, None, None, None), (6, 1, "user", "x"), (6, 1, "user", "x"), (None, 0, "user", "hi")]
    t = spark.createDataFrame([(*r, "i") for r in rows], "conv_id long, turn long, role string, text string, i string")
    compare(chat_formatting.collapse_and_render(t), chat_formatting.OP4_SQL, conversations=t.select("conv_id", F.col("turn"), "role", "text"))
    assert {(r.conv_id, r.n_copies) for r in chat_formatting.collapse_and_render(t).collect()} == {(3, 1), (4, 2), (6, 1)}


def plain_mixture(rows):
    """Scores by the same estimates, with expectation-maximisation over single tokens in place of bins."""
    from collections import Counter, defaultdict

    docs = {i: [b"<s>", *(t or "").encode().lower().split(), b"</s>"] for i, t in rows}
    train = {i: d for i, d in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    word, pair = Counter(), Counter()
    for d in train.values():
        word.update(d)
        pair.update(zip(d, d[1:]))
    total = sum(len(d) - 1 for d in train.values())
    types = len(word) - 1  # the begin is no token

    def estimates(v, w, one):
        n = word[v] - one
        return min(int(np.floor(np.log2(n + 1))), 23), np.array([(pair[v, w] - one) / n if n > 0 else 0.0, (word[w] - one) / max(total - one, 1), 1 / (types + 1)])

    seen = defaultdict(list)
    for d in train.values():
        for v, w in zip(d, d[1:]):
            k, p = estimates(v, w, 1)
            seen[k].append(p)
    weights = {}
    for k in range(24):
        if k not in seen:
            weights[k] = weights[k - 1] if k else np.array([0.0, 0.9, 0.1])
            continue
        p, w = np.array(seen[k]), np.array([0.4, 0.4, 0.2])
        for _ in range(50):
            share = w * p
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        w = np.maximum(w, 1e-6)
        weights[k] = w / w.sum()
    out = {}
    for i, d in docs.items():
        each = [estimates(v, w, 0) for v, w in zip(d, d[1:])]
        out[i] = sum(float(np.log10(weights[k] @ p)) for k, p in each)
    return out


def test_lm_mixture_by_plain_expectation_maximisation(spark, docs):
    want = plain_mixture(sample())
    got = {r.doc_id: r.score for r in ngram_lm.lm_scores(docs).collect()}
    assert set(got) == set(want)
    for i, s in want.items():
        assert abs(got[i] - s) <= 0.01 * abs(s) + 0.01, (i, got[i], s)


@pytest.mark.parametrize("every", [4, 5, 6, 8])
def test_decontamination_finds_edited_copies(spark, every):
    r = random.Random(every)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, [r.choice(words) for _ in range(30)]) for i in range(60)]
    rows = []
    for i, w in items:
        copy = [f"new{k}" if k % every == every - 1 else x for k, x in enumerate(w)]
        rows.append((i, " ".join([r.choice(words) for _ in range(40)] + copy + [r.choice(words) for _ in range(40)])))
    rows += [(1000 + i, " ".join(r.choice(words) for _ in range(110))) for i in range(60)]  # clean ones
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(got & {(i, i) for i in range(60)}) >= 54 and not got - {(i, i) for i in range(60)}


def test_long_words_that_mirror_each_other(spark):
    """A Thue-Morse word and its complement: sums of powers over their places are equal, the words are not."""
    one = "".join("ab" if bin(i).count("1") % 2 == 0 else "ba" for i in range(512))
    other = one.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {one}"), (2, f"{head} {other}"), (3, one), (4, other), (5, f"{head} {one}")]
    both = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(both).collect()}
    assert cut == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(both, 3, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    for change in ({}, {"fold": True}, {"other": True}):
        h, counts = B.word_hashes([one.encode(), b"", other.encode(), b"a\0", b"a", b"b A a"], **change)
        assert counts.tolist() == [1, 0, 1, 1, 1, 3]
        assert len(set(h.tolist())) == (5 if change.get("fold") else 6) and h[3] == h[6]


def test_decontamination_with_a_phrase_that_all_items_share(spark):
    """A stock phrase is no seed: an input full of it takes about as long as one without, and copies are found as before."""
    import time

    r = random.Random(8)
    word = lambda: f"w{r.randrange(20000)}"
    phrase = "which of the following".split()
    took, items = {}, [[*phrase, *(word() for _ in range(26))] for _ in range(800)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for stock in (False, True):
        rows = []
        for i in range(120):
            w = [word() for _ in range(2000)]
            for at in range(0, 2000, 50) if stock else ():
                w[at : at + 4] = phrase
            rows.append((i, " ".join(w)))
        copy = [x if k % 5 else "new" for k, x in enumerate(items[7])]
        rows += [(500, " ".join([*(word() for _ in range(300)), *copy, *phrase * 3])), (None, " ".join(items[9])), (None, " ".join(items[9]))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        start = time.time()
        got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()}
        took[stock] = time.time() - start
        assert got == {(500, 7), (None, 9)}
    assert took[True] < 3 * took[False] + 5


def test_minhash_keeps_every_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (5, "other " * 9), (2, None), (2, ""), (None, None), (9, text + " more")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, row int")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(5, 38, 5, True), (5, 38, 5, False), (None, 38, 5, False), (5, 1, 5, True), (2, 0, 2, True), (2, 0, 2, True), (None, 0, None, True), (9, 39, 5, False)], key=str)
