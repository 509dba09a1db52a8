"""Every query with SQL gives the rows that its SQL gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from stratalith.operators import graphs
from stratalith.operators.chunking import overlapping, windows
from stratalith.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_entry_imports_without_optional_parts():
    import __spark_entry__ as e

    assert e._optional("no_such_package.module") is None
    assert set(e.oracle_sql()) <= set(e.queries())


def test_windows_of_lines(spark):
    files = spark.createDataFrame([("a", "\n".join(map(str, range(51)))), ("b", "\n" * 49), ("c", "x")], "path string, content string")
    got = {(r.path, r.chunk, r.start_line, r.end_line) for r in windows(files, "path", "content", 50).collect()}
    assert got == {("a", 0, 1, 50), ("a", 1, 51, 51), ("c", 0, 1, 1)}


def test_overlapping_chunks_keep_every_line(spark):
    lines = [f"line {i}" for i in range(100)]
    files = spark.createDataFrame([("a", "\n".join(lines))], "path string, content string")
    chunks = [r.body.split("\n") for r in overlapping(files, "path", "content", most=100, overlap=2).orderBy("chunk").collect()]
    assert chunks[0] + [x for c in chunks[1:] for x in c[2:]] == lines


def test_long_cycles(spark):
    rings = [(100 + i, 100 + (i + 1) % 80) for i in range(80)] + [(1000 + i, 1000 + (i + 1) % 150) for i in range(150)]
    edges = spark.createDataFrame([*rings, (101, 1000), (1, 100)], "src long, dst long")
    assert {(r.node, r.cycle) for r in graphs.cycle_nodes(edges).collect()} == {(a, 100 if a < 1000 else 1000) for a, _ in rings}


def strong(edges):
    """Nodes on cycles, by plain reachability."""
    nodes = {x for e in edges for x in e}
    reach = {a: {b for s, b in edges if s == a} for a in nodes}
    for _ in nodes:
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    return {(a, min(b for b in r if a in reach[b])) for a, r in reach.items() if a in r}


@pytest.mark.parametrize("n, m", [(14, 17)])
def test_cycles_of_random_graphs(spark, n, m):
    import random

    rng = random.Random(n * m)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long")
    assert sorted(map(tuple, graphs.cycle_nodes(df).collect())) == sorted(strong(edges))


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graphs.cycle_nodes(none).collect() == graphs.components(none).collect() == []


def test_cycles_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "e"), ("g", "g")], "src string, dst string")
    assert {(r.node, r.cycle) for r in graphs.cycle_nodes(edges).collect()} >= {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e")}
    assert {(r.node, r.component) for r in graphs.components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e"), ("g", "g")}
