import random

from tokenizers import Tokenizer

import corpus_pipeline
from stratalith.llm import blocks
from stratalith.llm.token_ids import vocabulary


def test_stages_keep_columns_and_drop_bad_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= seen.count()
        seen = out
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in seen.select("doc_id").collect()}


SCHEMA = "doc_id long, text string, n_chars int"


def texts_after(stage, spark, rows, sf):
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], SCHEMA).repartition(3)
    return sorted(((x.doc_id, x.text) for x in stage(spark, docs, str(sf)).collect()), key=str)


def test_repeated_and_null_ids(spark, tmp_path):
    r = random.Random(6)
    plain = lambda n=40: " ".join(f"w{r.randint(0, 900)}" for _ in range(n))
    insult = " you idiot moron"
    labelled = [(i, plain() + insult * (i % 5 == 0)) for i in range(200)]
    clean = [x for x in labelled if x[0] % 5]
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = plain(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = [(300, plain()), (300, plain()), (None, plain()), (None, plain())]
    srt = lambda rows: sorted(rows, key=str)

    bad = [(300, plain() + insult), (None, plain() + insult)]
    assert texts_after(corpus_pipeline.toxicity, spark, labelled + some + bad, tmp_path) == srt(clean + some)
    # of equal texts the one with the smallest id stays, null ids come last
    bad = [(300, clean[0][1]), (None, clean[1][1]), (None, some[2][1])]
    assert texts_after(corpus_pipeline.minhash_dedup, spark, clean + some + bad, tmp_path) == srt(clean + some)
    # one text of an id is cut, the other stays as it is
    own = [plain(10), plain(10)]
    cut = [(300, f"{own[0]} {clean[0][1]}"), (None, f"{clean[1][1]} {own[1]}"), (300, clean[2][1])]
    want = srt([*clean, *some, (300, own[0]), (None, own[1])])
    assert texts_after(corpus_pipeline.substring_cut, spark, clean + some + cut, tmp_path) == want
    bad = [(300, f"{plain()} {item}"), (None, f"{item} {plain()}")]
    assert texts_after(corpus_pipeline.decontamination, spark, clean + some + bad, tmp_path) == srt(clean + some)


def shingles(t):
    w = t.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_near_duplicates(rows):
    """Rows but the first of each component of pairs with a similarity of 0.8."""
    sets, first = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                first[max(x, y)] = min(x, y)
    return [row for k, row in enumerate(rows) if find(k) == k]


def plain_cuts(rows):
    seen, out = {}, []
    for k, (i, t) in enumerate(rows):
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if seen.setdefault(tuple(w[p : p + 13]), k) < k:
                gone[p : p + 13] = [True] * 13
        if not any(gone):
            out.append((i, t))
        elif not all(gone):
            out.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def plain_alignment(a, b):
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, new[j] - 1))
        h, best = new, max(best, max(new))
    return best


def test_run_against_plain_python(spark, tmp_path):
    r = random.Random(12)
    word = lambda: r.choice(("the", "of", "and", "in")) if r.random() < 0.3 else f"w{r.randint(0, 600)}"
    plain = lambda n=60: [word() for _ in range(n)]
    edited = lambda w, share: [f"x{r.randint(0, 9)}" if r.random() < share else x for x in w]
    items = {i: plain(n) for i, n in enumerate((20, 30, 40, 60))}
    insult = ["you", "idiot", "moron"]
    rows = [(i, plain() + insult * (i % 5 == 0)) for i in range(200)]
    clean = [w for i, w in rows if i % 5]
    for k in range(12):
        rows.append((300 + k, edited(clean[k], 0.01)))  # near copies
        rows.append((300 + k // 2, plain(20) + clean[20 + k][10:40] + plain(20)))  # repeated passages, repeated ids
        rows.append((None if k % 3 else 400 + k, clean[40 + k][:30]))  # nothing of their own
    for k, w in items.items():
        rows.append((500 + k, plain(30) + w + plain(30)))
        rows.append((510 + k, plain(30) + w[: len(w) // 2 + 1] + plain(30)))
        rows += [(520 + 10 * k + c, plain(30) + edited(w, share) + plain(30)) for c, share in enumerate((0.1, 0.15, 0.2, 0.25))]
        rows.append((None, plain(10) + edited(w, 0.1)))
    rows += [(None, plain()), (None, plain() + insult), (600, []), (601, plain(4))]
    rows = [(i, " ".join(w)) for i, w in rows]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, len(t)) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    want = sorted((x for x in rows if "idiot" not in x[1].split()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    n = [len(rows), len(want)]
    for step in (plain_near_duplicates, plain_cuts, lambda rows: [x for x in rows if not any(plain_alignment(w, x[1].split()) >= min(len(w), 30) for w in items.values())]):
        want = step(want)
        n.append(len(want))
    assert n[0] > n[1] > n[2] >= n[3] > n[4]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = blocks.stored(stage(spark, docs, sf), "stage")
    assert sorted(((x.doc_id, x.text) for x in docs.collect()), key=str) == sorted(want, key=str)
    end = Tokenizer.from_file(vocabulary())
    tokens = sorted((str(i), len(end.encode(t, add_special_tokens=False).ids) + 1) for i, t in want)
    starts = corpus_pipeline.run(spark, sf).filter("start = 0").collect()
    assert sorted((str(x.doc_id), x.doc_tokens) for x in starts) == tokens


def test_columns_of_clashing_names_and_awkward_texts(spark, tmp_path):
    """Columns that the stages or operators use themselves come out as they went in."""
    r = random.Random(3)
    plain = lambda n=40: " ".join(f"w{r.randint(0, 900)}" for _ in range(n))
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, plain(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = plain(20)
    kept = [(1, f"{shared} {plain()}"), (2, plain()), (3, None), (4, ""), (5, " \n"), (6, plain(3000))]
    names = ["id", "row", "_row", "_row_", "n_words", "n_removed", "kept_text", "kept", "predicted", "component_id", "a.b", "class_id", "n"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names)
    frame = lambda rows: spark.createDataFrame([(i, t, *(f"{c}{i}" for c in names)) for i, t in rows], schema)
    docs = frame([*kept, (7, f"own {shared}")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {x["doc_id"]: x for x in out.collect()}
        assert set(got) == set(range(1, 8)), name
        assert all(x[c] == f"{c}{i}" for i, x in got.items() for c in names), name
        assert got[7]["text"] == ("own" if name == "substring_dedup" else f"own {shared}")
        assert all(got[i]["text"] == t for i, t in kept)
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
    assert {x["doc_id"] for x in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()} == set(range(1, 8))
    assert corpus_pipeline.packing(spark, docs.limit(0), str(tmp_path)).count() == 0
