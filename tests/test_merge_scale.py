"""Merges of chunks in tasks of bounded rows."""


def test_chunks_are_merged_in_tasks_of_bounded_rows(spark, tmp_path):
    from stratalith.plans import registry

    rows = spark.range(600_000).selectExpr("id AS l_orderkey", "id AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.0D AS l_extendedprice", "1.0D AS l_quantity")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        merged = registry.queries()["small_chunk_merge"](spark, str(tmp_path))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # one exchange, of as many tasks as there are cores or rows by the quarter million
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and merged.count() == 600_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
