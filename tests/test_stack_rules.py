"""Stack rules against plain Python, with rules of the user's."""

import random

import pytest

from stratalith.operators import stack_rules as S


def plain(files, rules, marks):
    out = {}
    for project in {f[0] for f in files} | {m[0] for m in marks}:
        own = [f for f in files if f[0] == project]
        texts = [("content", t.lower()) for _, _, t in own if t] + [(c, t.lower()) for p, c, t in marks if p == project and t]
        texts += [("manifest", t.lower()) for _, p, t in own if t and p and p.rsplit("/", 1)[-1] in S.MANIFESTS]
        names = [p.rsplit("/", 1)[-1] for _, p, _ in own if p]
        sums, sure = {}, {}
        for category, technology, place, kind, term, points in rules:
            key = (category, technology, place)
            if kind == "indicator":
                for channel, each in S.CHANNELS.items():
                    if any(c == channel and term.lower() in t for c, t in texts):
                        sums[key] = sums.get(key, 0) + each
                        if channel in ("content", "manifest"):
                            sure.setdefault(key, set()).add(term.lower())
            elif kind == "dependency" and any(c == "manifest" and term.lower() in t for c, t in texts):
                sums[key] = sums.get(key, 0) + points
            elif kind == "config" and term in names:
                sums[key] = sums.get(key, 0) + points
            elif kind == "extension" and (n := sum("." in x and "." + x.rsplit(".", 1)[-1].lower() == term for x in names)):
                sums[key] = sums.get(key, 0) + points * min(n, 5)
        for key, points in sums.items():
            bonus = S.BONUS.get(key[0], (0, ()))
            points += bonus[0] * sum(any(c == "content" and w in t for c, t in texts) for w in bonus[1])
            k = len(sure.get(key, ()))
            out[project, *key] = min(100, max(points, 70 + 5 * k) if points < 70 and k else points)
    return out


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(1)
    letters = lambda n: "".join(r.choice("abcAB.") for _ in range(n))
    rules = [(f"c{k % 3}", f"t{k % 40}", k % 40, "indicator", letters(r.randint(2, 6)), None) for k in range(1500)]
    rules += [("database", "x", 0, "dependency", "Lib-X", 33), ("database", "x", 0, "config", "x.toml", 30), ("database", "y", 1, "extension", ".yy", 20), ("database", "z", 2, "extension", ".yy", 1), ("database", "w", 3, "config", "X.toml", 5)]
    files = [(f"p{i % 4}", f"src/a{i}.yy", letters(300)) for i in range(11)]
    files += [("p0", "pom.xml", "uses lib-x and SELECT"), ("p1", "d/x.toml", None), ("p1", None, "insert"), ("p2", "deep/Makefile", ""), ("p3", "b.YY", "create table")]
    marks = [("p0", "import", letters(80)), ("p1", "annotation", letters(80)), ("p9", "pattern", letters(80)), ("p9", "import", None)]
    return rules, files, marks


def test_scores(spark, case):
    rules, files, marks = case
    got = S.stack_scores(spark.createDataFrame(files, "project string, path string, content string"), S.rules_of(spark, rules), spark.createDataFrame(marks, "project string, channel string, text string"))
    assert {tuple(x)[:4]: x["score"] for x in got.collect()} == plain(files, rules, marks)


def test_detected_ties_and_alternatives(spark):
    rows = [("p", "c", f"t{k}", k, s) for k, s in enumerate((100, 100, 69, 71, 80, 100, 70))] + [("q", "c", "t", 0, 69), ("r", "c", "t", 0, 70)]
    got = S.detected(spark.createDataFrame(rows, "project string, category string, technology string, place int, score long")).orderBy("project").collect()
    assert [tuple(x) for x in got] == [("p", "c", "t0", 100, ["t1", "t5", "t4"]), ("r", "c", "t", 70, [])]


def test_no_files_no_rules(spark, case):
    rules, files, _ = case
    some, none = spark.createDataFrame(files, "project string, path string, content string"), spark.createDataFrame([], "project string, path string, content string")
    assert S.stack_scores(none, S.rules_of(spark)).count() == 0
    assert S.stack_scores(some, S.rules_of(spark, [])).count() == 0
    assert len({r[1] for r in S.starter_rules()}) == 59
