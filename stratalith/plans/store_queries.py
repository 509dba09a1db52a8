"""Queries that write to a project store below the shared folder and read back what holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import ProjectStore, hashed
from ..sources.tables import shared_dir, table
from ..streaming import results
from .project_corpus import PROJECT_SQL, project_files
from .registry import query
from .stages import Stage, StageGraph

_LOC = "CAST(len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) AS BIGINT)"


def _store(spark: SparkSession) -> ProjectStore:
    return ProjectStore(spark, shared_dir(spark, "store"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_files(spark, sf_dir).select("path", F.lit("code").alias("language"), "content", F.concat(F.lit("p"), F.col("project").cast("string")).alias("project_id"))


@query(f"WITH {PROJECT_SQL} SELECT 'p' || project AS project_id, path, sha256(content) AS content_hash, {_LOC} AS loc FROM project_files WHERE project <> 1 OR path LIKE '%.md'")
def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all projects in one commit; one project is removed, and some of its files put back."""
    s, files = _store(spark), _files(spark, sf_dir)
    s.append("files", hashed(files))
    s.create_project("p1", "one")
    s.delete_project("p1")
    s.append("files", hashed(files.filter("project_id = 'p1' and path like '%.md'")))
    s.compact()
    return s.read("files").select("project_id", "path", "content_hash", "loc")


@query(
    f"""WITH {PROJECT_SQL} SELECT 'p' || project AS project_id, path, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM project_files WHERE project IN (0, 2) AND path LIKE '%.java'
    UNION ALL SELECT 'p' || project, path, CAST(octet_length(encode(content)) AS BIGINT) FROM project_files WHERE project = 3 AND path LIKE '%.py'"""
)
def store_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformed files, replaced project by project: the last ones count."""
    s, files = _store(spark), _files(spark, sf_dir)
    own = lambda p, end: files.filter((F.col("project_id") == p) & F.col("path").endswith(end))
    for p, end in (("p0", ".py"), ("p2", ".java"), ("p3", ".java"), ("p0", ".java"), ("p3", ".py")):
        s.replace_transformed(p, own(p, end))
    return s.read("transformed").select("project_id", "path", "size")


@query(
    """WITH sums AS (SELECT 'r' || n_regionkey AS project_id, count(*) AS n, n_regionkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)
    SELECT project_id, 'customers' AS result_type, CAST(n AS VARCHAR) AS data FROM sums WHERE k <> 4 UNION ALL SELECT project_id, 'state', 'second' FROM sums WHERE k % 2 = 0 AND k <> 4 UNION ALL SELECT project_id, 'state', 'first' FROM sums WHERE k % 2 = 1"""
)
def store_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by region, some given twice: the last of each kind; a deleted project has none."""
    s = _store(spark)
    sums = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").count()
    for k, n in sorted(map(tuple, sums.collect())):  # a row for each region
        s.append_result(f"r{k}", "customers", "0")
        s.append_result(f"r{k}", "customers", str(n))
        s.append_result(f"r{k}", "state", "first")
        if k % 2 == 0:
            s.append_result(f"r{k}", "state", "second")
    s.delete_project("r4")
    return s.results().select("project_id", "result_type", "data")


@query("SELECT 'r' || r_regionkey AS project_id, r_name || ' renamed' AS name, CASE WHEN r_regionkey = 2 THEN 'running' ELSE 'created' END AS status FROM region WHERE r_regionkey <> 3")
def store_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects made, renamed, set running and deleted: what each is now."""
    s = _store(spark)
    for r in table(spark, sf_dir, "region").collect():  # five rows
        s.create_project(f"r{r['r_regionkey']}", f"  {r['r_name']} ")
        s.update_project(f"r{r['r_regionkey']}", name=f"{r['r_name']} renamed")
    s.set_status("r2", "running")
    s.delete_project("r3")
    return s.projects().select("project_id", "name", "status")


@query("SELECT 'run' || r_regionkey AS run_id, 'parse' AS stage, CASE r_regionkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS event, CASE WHEN r_regionkey % 3 < 2 THEN r_name END AS data FROM region")
def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage runs begun, some of them ended: the state of each."""
    s = _store(spark)
    for r in table(spark, sf_dir, "region").collect():  # five rows
        k = r["r_regionkey"]
        s.start_run("p", f"run{k}", "parse")
        if k % 3 < 2:
            s.complete_run("p", f"run{k}", "parse", ("completed", "failed")[k % 3], r["r_name"])
    return s.runs().select("run_id", "stage", "event", "data")


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, len(embedding) AS size, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM embeddings WHERE label % 2 = 0")
def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors saved twice and loaded: the second set counts."""
    s = _store(spark)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("").alias("body"), "embedding", "label")
    s.save_vectors("p", vectors)
    s.save_vectors("q", vectors.filter("label = 1"))
    s.save_vectors("p", vectors.filter("label % 2 = 0"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return s.load_vectors("p").select("chunk_id", F.size("embedding").cast("long").alias("size"), F.round(norm, 4).alias("norm"))


@query(f"WITH {PROJECT_SQL} SELECT path, sha256(upper(content)) AS content_hash FROM project_files")
def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a stream, each transformed and stored once though the stream is started twice over."""
    s, files = _store(spark), project_files(spark, sf_dir).select("path", F.lit("code").alias("language"), "content")
    folder = shared_dir(spark, "stream")
    files.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    # the second run has forgotten what the first one did
    for run in ("a", "b"):
        results.store_each(stream, s, "p", "files", lambda b: hashed(b.withColumn("content", F.upper("content"))), f"{folder}/{run}", "upper").awaitTermination()
    return s.read("files").select("path", "content_hash")


@query("SELECT stage, event FROM (VALUES ('files', 'completed'), ('python', 'completed'), ('empty', 'skipped'), ('count', 'completed')) v(stage, event) WHERE (SELECT count(*) FROM part) > 0")
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a graph of stages after a failure and a restart from the stage that failed."""
    broken = [True]

    def count(state):
        if broken:
            broken.pop()
            raise RuntimeError("lost")
        return {"n": state["python"].groupBy("project").count()}

    stages = [
        Stage("files", lambda state: {"files": project_files(spark, sf_dir)}),
        Stage("python", lambda state: {"python": state["files"].filter("path like '%.py'")}),
        Stage("empty", lambda state: {}, lambda state: "nothing" in state),
        Stage("count", count),
    ]
    graph = StageGraph(spark, stages, shared_dir(spark, "stages"))
    try:
        graph.run({})
    except RuntimeError:
        graph.run({}, "count")
    return spark.createDataFrame(list(graph.status().items()), "stage string, event string")
