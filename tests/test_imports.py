"""Imports of any number of segments, against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratalith.operators import imports


@pytest.mark.parametrize("long", [13, 14, 40])
def test_imports_of_any_number_of_segments(spark, long):
    names = [f"s{k}" for k in range(long)]
    paths_ = ["m.py", "p/" + "/".join(names) + ".py", "q/" + "/".join(names) + "/x.py", "p/" + "/".join(names[1:]) + "9.py"]
    files = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths_)], "project long, file_no long, path string")
    asked = [".".join(names), "/".join(names[1:]), ".".join(["q", *names, "*"]), "./p/" + "/".join(names), ".".join(names) + "9", ".".join(names[1:-1]), ".".join([*names, "x", "y"])]
    rows = spark.createDataFrame([(1, "m.py", n) for n in asked], "project long, path string, name string")
    got = {r["import"]: r["dst"] for r in imports.resolved(files, rows).collect()}
    assert got == {asked[0]: paths_[1], asked[1]: paths_[1], asked[2]: paths_[2], asked[3]: paths_[1], asked[5]: paths_[1]}


def test_imports_by_brute_force(spark):
    draw = random.Random(4)
    texts = {k: sorted({"/".join(draw.choice("ab") for _ in range(draw.randint(1, 30))) + draw.choice([".py", "", ".d.py"]) for _ in range(40)} | {"", "/a/b.py", "a//b.py", "b/.py"}) for k in range(3)}
    files = [(k, i, p) for k, each in texts.items() for i, p in enumerate(each)]
    asked = {(k, p, n) for k in texts for p in draw.sample(texts[k], 12) for n in ["", ".", "/", "a//b", "/a", "./a", "../a/b", *(draw.choice("./").join(draw.choice("ab") for _ in range(draw.randint(1, 24))) for _ in range(8)), *("/".join(draw.choice(texts[k]).split("/")[i:j]) for i in range(3) for j in range(2, 30, 4))]}
    rows = spark.createDataFrame(sorted(asked), "project long, path string, name string")
    runs = rows.select("project", "path", "name", imports.wanted(F.col("path"), F.col("name")).alias("run")).collect()

    def holds(path: str, run: str) -> bool:
        parts, want = ["", *re.sub(r"\.[^./]*$", "", path).split("/")], run.split("/")
        return any(parts[i : i + len(want)] == want for i in range(len(want) == 1, len(parts)))

    first = {tuple(r): next((p for p in texts[r.project] if holds(p, r.run)), None) for r in runs}
    want = {(k, src, n): dst for (k, src, n, _), dst in first.items() if dst is not None and dst != src}
    got = {(r["project"], r["src"], r["import"]): r["dst"] for r in imports.resolved(spark.createDataFrame(files, "project long, file_no long, path string"), rows).collect()}
    assert got == want and sum(n.count("/") + n.count(".") > 12 for _, _, n in want) > 20
