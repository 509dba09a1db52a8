"""Table functions in SQL: what they take, and what they refuse."""

import pytest

from stratalith.functions import udtfs


def test_chunks_by_partition(spark):
    udtfs.register(spark)
    rows = [("a", i, f"l{i}") for i in range(7)] + [("b", 0, None), ("b", 1, " "), ("c", 5, "x")]
    spark.createDataFrame(rows, "key string, n long, line string").repartition(3).createOrReplaceTempView("udtf_lines")
    got = spark.sql("SELECT * FROM chunks(TABLE(udtf_lines) PARTITION BY key ORDER BY n, size => 3)").collect()
    assert sorted((r["key"], r["chunk"], r["first"], r["last"], r["body"]) for r in got) == [("a", 0, 0, 2, "l0\nl1\nl2"), ("a", 1, 3, 5, "l3\nl4\nl5"), ("a", 2, 6, 6, "l6"), ("c", 0, 5, 5, "x")]
    assert spark.sql("SELECT * FROM chunks(TABLE(SELECT * FROM udtf_lines WHERE false) PARTITION BY key ORDER BY n)").count() == 0


@pytest.mark.parametrize(
    "call, says",
    [
        ("chunks(TABLE(SELECT 1 AS a) PARTITION BY a)", "needs the columns"),
        ("chunks(TABLE(SELECT 1L AS n, 'x' AS line) PARTITION BY n, size => 0)", "positive"),
        ("chunks(1)", "must be a table"),
        ("ddl_columns(1)", "must be a string"),
        ("code_units('a.py', 2)", "must be a string"),
    ],
)
def test_wrong_calls_are_refused(spark, call, says):
    udtfs.register(spark)
    with pytest.raises(Exception, match=says):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_nulls_give_no_rows(spark):
    udtfs.register(spark)
    assert spark.sql("SELECT * FROM VALUES ('a.py', NULL), (NULL, 'x = 1'), ('a.zzz', 'x') AS f(path, content), LATERAL code_units(f.path, f.content)").count() == 0
    assert spark.sql("SELECT * FROM ddl_columns(CAST(NULL AS STRING))").count() == 0
