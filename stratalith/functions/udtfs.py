"""Table functions for SQL: code_units, ddl_columns and chunks.

    register(spark)
    SELECT f.path, u.head FROM files f, LATERAL code_units(f.path, f.content) u
    SELECT f.path, d.* FROM files f, LATERAL ddl_columns(f.content) d
    SELECT * FROM chunks(TABLE(lines) PARTITION BY path ORDER BY n, size => 50)

The first two take one text at a time, and give the same rows for the same text, so that
conditions on the files' own columns hold before texts are read.  The third takes all rows of a partition, in order,
and holds no more of them than a chunk has; which columns it has depends on the call.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import ddl, lexing


def _is_text(argument: AnalyzeArgument, name: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, T.StringType | T.NullType):
        raise ValueError(f"{name} must be a string")


@udtf
class CodeUnits:
    """Units of a file's text; none of a null or of a language that isn't known."""

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
        _is_text(path, "path")
        _is_text(content, "content")
        return AnalyzeResult(T.StructType().add("unit", T.IntegerType()).add("parent", T.IntegerType()).add("depth", T.IntegerType()).add("kind", T.StringType()).add("start_line", T.IntegerType()).add("end_line", T.IntegerType()).add("head", T.StringType()).add("strings", T.ArrayType(T.StringType())))

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        language = lexing.EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower())
        if language and content is not None:
            for row in lexing.units_of(path, language, content):
                yield row[2:]


@udtf
class DdlColumns:
    """Columns of the tables that a DDL text creates; none of a null."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        _is_text(content, "content")
        return AnalyzeResult(T.StructType().add("table_name", T.StringType()).add("ordinal", T.IntegerType()).add("name", T.StringType()).add("type", T.StringType()).add("nullable", T.BooleanType()).add("primary_key", T.BooleanType()))

    def eval(self, content: str) -> Iterator[tuple]:
        for row in ddl.parsed(content):
            if row["kind"] == "column":
                yield row["table_name"], row["ordinal"], row["name"], row["type"], row.get("nullable"), row.get("primary_key")


@dataclass
class ChunkPlan(AnalyzeResult):
    """What a call of chunks asks for."""

    size: int = 50
    keys: list[str] = field(default_factory=list)


@udtf
class Chunks:
    """Runs of `size` lines of each partition: the partition's columns, then chunk, first, last and body.

    The table has the columns that it is partitioned by, n and line; blank runs go."""

    def __init__(self, plan: ChunkPlan):
        self.size, self.keys = plan.size, plan.keys
        self.key: tuple = ()
        self.held: list[tuple] = []
        self.chunk = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument | None = None) -> ChunkPlan:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        if size is not None and not (size.isConstantExpression and isinstance(size.value, int) and size.value > 0):
            raise ValueError("size must be a positive whole number")
        names = [f.name for f in rows.dataType]
        if not {"n", "line"} <= set(names):
            raise ValueError("the table needs the columns n and line")
        keys = [f for f in rows.dataType if f.name not in ("n", "line")]
        out = T.StructType(list(keys)).add("chunk", T.IntegerType()).add("first", T.LongType()).add("last", T.LongType()).add("body", T.StringType())
        return ChunkPlan(out, size=size.value if size is not None else 50, keys=[f.name for f in keys])

    def _out(self) -> Iterator[tuple]:
        body = "\n".join(line or "" for _, line in self.held)
        if body.strip():
            yield (*self.key, self.chunk, self.held[0][0], self.held[-1][0], body)
        self.chunk += 1
        self.held = []

    def eval(self, row, size: int = 50) -> Iterator[tuple]:
        self.key = tuple(row[k] for k in self.keys)
        self.held.append((row["n"], row["line"]))
        if len(self.held) == self.size:
            yield from self._out()

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self._out()


def register(spark: SparkSession) -> None:
    for name, f in (("code_units", CodeUnits.asDeterministic()), ("ddl_columns", DdlColumns.asDeterministic()), ("chunks", Chunks)):
        spark.udtf.register(name, f)
