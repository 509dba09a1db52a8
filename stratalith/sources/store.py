"""A project store: tables below one folder, each with a log of commits, and views of what holds now.

Nothing is updated in place.  Statuses, results and runs are events in the log itself,
and a view takes the latest of each key; files and vectors are written to a folder of
their commit.  Commits of one project have a folder for it, so it can go from disk at once;
those of many projects have files of many (folders would be as many as projects), and
the few files that hold a project which goes are written anew without it.  A commit may replace or remove a project's rows in a table: then those
of earlier commits are gone.  Writers need no lock, and a crash leaves nothing half done
(see commits.py).  An event's number is its commit's, so later events have greater ones.
"""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.matches import first_by_priority
from .commits import CommitLog

#: Tables of events, which are in the log, and tables of data, of which a project's rows can go from disk.
EVENTS = ("projects", "results", "runs")
#: Tables and their columns.
TABLES = {
    "projects": "project_id string, name string, description string, status string, at timestamp, number long",
    "results": "result_type string, data string, at timestamp, number long, project_id string",
    "files": "path string, language string, content string, content_hash string, loc long, project_id string",
    "context": "kind string, name string, data string, project_id string",
    "transformed": "path string, content string, content_hash string, size long, loc long, project_id string",
    "runs": "run_id string, stage string, event string, data string, at timestamp, number long, project_id string",
    "vectors": "chunk_id string, body string, embedding array<float>, project_id string",
}


def latest(events: DataFrame, *key: str) -> DataFrame:
    """The last event of each key, by time and number."""
    order = W.partitionBy(*key).orderBy(F.desc("at"), F.desc("number"))
    return events.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def latest_fields(events: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each key the last value of each field that isn't null, when it began, and when it last changed."""
    when = F.struct("at", "number")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), when)).alias(f) for f in fields]
    return events.groupBy(key).agg(*last, F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def hashed(files: DataFrame) -> DataFrame:
    """files with the hash of their contents and their lines that aren't blank."""
    lines = F.size(F.filter(F.split("content", r"\r\n|\r|\n"), lambda s: F.trim(s) != ""))
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn("loc", lines.cast("long"))


class ProjectStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.logs = {t: CommitLog(spark, f"{self.path}/log/{t}") for t in TABLES}

    def read(self, table: str) -> DataFrame:
        """What a table holds, empty before anything is in it."""
        entries = self.logs[table].entries()
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        names = [f.name for f in schema]
        ends = entries.filter(F.col("kind").isin("replace", "remove")).groupBy(F.col("project_id").alias("_ended")).agg(F.max("number").alias("_from"))
        rows = self._data(table, entries)
        if table in EVENTS:
            if rows is not None:
                rows = rows.withColumn("at", F.coalesce("at", "_at")).withColumn("number", F.col("_number")).select(*names, "_number")
            row = [F.col(f.name) if f.name in ("at", "number") else F.col("project_id") if f.name == "project_id" else F.col("row")[f.name].cast(f.dataType).alias(f.name) for f in schema]
            events = entries.filter("kind = 'event'").select(*row, F.col("number").alias("_number")).select(*names, "_number")
            rows = events if rows is None else rows.unionByName(events)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        kept = rows.join(ends, rows.project_id == F.col("_ended"), "left").filter("_from is null or _number >= _from")
        return kept.select(*names)

    def _parquet(self, place: str, table: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{TABLES[table]}, commit string").parquet(f"{self.path}/{place}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _bulk(self, table: str, entries: DataFrame) -> DataFrame | None:
        """Rows of commits of many projects, with the file of each; without files that were written anew."""
        data = self._parquet("bulk", table)
        if data is None:
            return None
        file = F.concat_ws("/", "commit", F.col("_metadata.file_name"))
        return data.withColumn("_file", file).join(entries.filter("kind = 'rewrite'").select(F.col("row")["file"].alias("_file")), "_file", "left_anti")

    def _data(self, table: str, entries: DataFrame) -> DataFrame | None:
        """Rows that commits have added, with their number and time; those written anew keep the number that they had."""
        bulk = self._bulk(table, entries)
        parts = [p for p in (self._parquet("data", table), bulk and bulk.drop("_file")) if p is not None]
        if not parts:
            return None
        number = F.coalesce(F.col("row")["number"].cast("long"), F.col("number"))
        known = entries.filter("commit is not null").select("commit", number.alias("_number"), F.col("at").alias("_at"))
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).join(known, "commit")

    def append(self, table: str, rows: DataFrame, once: tuple[str, int] | None = None, kind: str = "add", project_id: str | None = None) -> None:
        """Adds rows to a table, of one project or, if it isn't named, of any number; once: a source and the number of its batch, which is added one time alone.

        Rows of a table of events all get the commit's number, and its time where they have none."""
        if table in EVENTS:
            rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("at", "timestamp"), ("number", "long")) if c not in rows.columns})
        if once and self.logs[table].has(once):
            return
        names = [f.name for f in self.spark.createDataFrame([], TABLES[table]).schema]
        commit = uuid.uuid4().hex
        rows = rows.select(*names)
        if table in EVENTS or project_id is None:
            # a project's rows come to lie in one file, or a few
            rows = rows if table in EVENTS else rows.hint("rebalance", "project_id")
            rows.write.parquet(f"{self.path}/bulk/{table}/commit={commit}")
        else:
            rows.write.partitionBy("project_id").parquet(f"{self.path}/data/{table}/commit={commit}")
        self.logs[table].commit(kind, project_id, commit, once=once)

    def _event(self, table: str, project_id: str, **values) -> None:
        self.logs[table].commit("event", project_id, row=values)

    # projects: made, changed in part, looked up, gone
    def create_project(self, project_id: str, name: str, description: str | None = None) -> None:
        if not name or not name.strip():
            raise ValueError("a project needs a name")
        self._event("projects", project_id, name=name.strip(), description=description, status="created")

    def update_project(self, project_id: str, **fields) -> None:
        if "name" in fields and not (fields["name"] or "").strip():
            raise ValueError("a project needs a name")
        self._event("projects", project_id, **fields)

    def projects(self) -> DataFrame:
        return latest_fields(self.read("projects"), "project_id", ["name", "description", "status"]).filter("status is distinct from 'deleted'").orderBy(F.desc("created_at"), "project_id")

    def project(self, project_id: str) -> DataFrame:
        return self.projects().filter(F.col("project_id") == project_id)

    def set_status(self, project_id: str, status: str) -> None:
        self._event("projects", project_id, status=status)

    def delete_project(self, project_id: str) -> None:
        """The project's rows of all tables go, first from the log, then from disk; its events stay, ended by one that says so."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project_id)
        for table in TABLES:
            if table == "projects":
                continue
            self.logs[table].commit("remove", project_id)
            if table not in EVENTS:
                top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{table}")
                fs = top.getFileSystem(conf)
                for commit in fs.listStatus(top) if fs.exists(top) else []:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(commit.getPath(), f"project_id={folder}"), True)
                self._write_without(table, project_id)
        self._event("projects", project_id, status="deleted")

    def _write_without(self, table: str, project_id: str) -> None:
        """Files of many projects that hold this one are written anew without it, and go once the log says so.

        Of two writers of one file the first counts, and the other begins again with what is then there."""
        log, top, path = self.logs[table], f"{self.path}/bulk/{table}", self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(top).getFileSystem(self.spark._jsc.hadoopConfiguration())
        while True:
            entries = log.entries()
            bulk = self._bulk(table, entries)
            own = bulk and bulk.filter(F.col("project_id") == project_id).select("commit", "_file").distinct()
            number = F.coalesce(F.col("row")["number"].cast("long"), F.col("number"))
            held = own.join(entries.select("commit", number.alias("n")), "commit").collect() if bulk else []  # one file, or a few
            if not held:
                return
            for r in held:
                new, file = uuid.uuid4().hex, f"{top}/commit={r['_file']}"
                rest = self.spark.read.schema(TABLES[table]).parquet(file).filter(~F.col("project_id").eqNullSafe(project_id))
                rest.coalesce(1).write.parquet(f"{top}/commit={new}")
                log.commit("rewrite", None, new, row={"file": r["_file"], "number": r["n"]}, once=(f"rewrite {r['_file']}", 0))
                lost = log.entries().filter(F.col("commit") == new).isEmpty()
                fs.delete(path(f"{top}/commit={new}" if lost else file), True)

    def compact(self) -> None:
        """Keeps the logs short."""
        for log in self.logs.values():
            log.compact()

    # results
    def append_result(self, project_id: str, result_type: str, data: str) -> None:
        self._event("results", project_id, result_type=result_type, data=data)

    def results(self) -> DataFrame:
        """The last result of each kind and project: appending one again replaces it here."""
        return latest(self.read("results"), "project_id", "result_type")

    def result(self, project_id: str, kinds: list[str], default: str | None = None, given: DataFrame | None = None) -> DataFrame:
        """(result_type, data): what is given, else the result of the first kind that there is, else the default."""
        stored = self.results().filter(F.col("project_id") == project_id)
        tries = [] if given is None else [given.select("result_type", "data")]
        tries += [stored.filter(F.col("result_type") == k).select("result_type", "data") for k in kinds]
        if default is not None:
            tries.append(self.spark.createDataFrame([(None, default)], "result_type string, data string"))
        return first_by_priority([t.withColumn("project_id", F.lit(project_id)) for t in tries], "project_id").drop("project_id")

    def store_orchestration(self, project_id: str, files: DataFrame, context: DataFrame, results: dict[str, str], status: str) -> None:
        """What a run gives goes to its four tables; the status comes last, so a failure before leaves the old one."""
        self.put_files(project_id, files)
        self.put_context(project_id, context)
        for kind, data in results.items():
            self.append_result(project_id, kind, data)
        self.set_status(project_id, status)

    # files
    def put_files(self, project_id: str, files: DataFrame) -> None:
        self.append("files", hashed(files).withColumn("project_id", F.lit(project_id)), project_id=project_id)

    def put_context(self, project_id: str, elements: DataFrame) -> None:
        self.append("context", elements.withColumn("project_id", F.lit(project_id)), project_id=project_id)

    def replace_transformed(self, project_id: str, files: DataFrame) -> None:
        """The project's transformed files become these."""
        rows = hashed(files).withColumn("size", F.octet_length("content").cast("long")).withColumn("project_id", F.lit(project_id))
        self.append("transformed", rows, kind="replace", project_id=project_id)

    # stage runs
    def start_run(self, project_id: str, run_id: str, stage: str) -> None:
        self._event("runs", project_id, run_id=run_id, stage=stage, event="running")

    def complete_run(self, project_id: str, run_id: str, stage: str, event: str = "completed", data: str | None = None) -> None:
        self._event("runs", project_id, run_id=run_id, stage=stage, event=event, data=data)

    def runs(self) -> DataFrame:
        return latest(self.read("runs"), "project_id", "run_id", "stage")

    # vectors
    def save_vectors(self, project_id: str, vectors: DataFrame) -> None:
        self.append("vectors", vectors.select("chunk_id", "body", "embedding", F.lit(project_id).alias("project_id")), kind="replace", project_id=project_id)

    def load_vectors(self, project_id: str) -> DataFrame:
        return self.read("vectors").filter(F.col("project_id") == project_id)


def artifact_zip(files: DataFrame, readme: str = "# Transformed project\n") -> bytes:
    """A ZIP of files (path, content), which pass through the driver one partition at a time; with a README if there is none."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        seen = set()
        for r in files.select("path", "content").orderBy("path").toLocalIterator():
            if r["path"] not in seen:
                z.writestr(r["path"], r["content"] or "")
            seen.add(r["path"])
        if not any(p.lower().rsplit("/", 1)[-1].startswith("readme") for p in seen):
            z.writestr("README.md", readme)
    return out.getvalue()


def capped(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first rows of a report's table, in a stated order."""
    return rows.orderBy(*order).limit(most)


def report_tables(apis: DataFrame, tables: DataFrame, frameworks: DataFrame, components: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report: 50 endpoints, 50 database tables, 5 frameworks, 10 components of each layer."""
    place = F.row_number().over(W.partitionBy("layer").orderBy("name"))
    return {
        "apis": capped(apis, 50, "path", "method"),
        "tables": capped(tables, 50, "name"),
        "frameworks": capped(frameworks, 5, F.desc("score"), "name"),
        "components": components.withColumn("place", place).filter("place <= 10"),
    }
