"""Source trees as tables, by a data source of Spark's, and tables as source trees.

The driver walks the tree and never enters a skipped folder; it knows names and sizes
alone.  Files are dealt out to partitions of bounded bytes and numbers, and read in
tasks.  Names that begin with a dot or an underscore, and empty files, are files like any
other, which Spark's own file sources leave out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is read, what is never entered, and what is never read.
SUPPORTED_EXTENSIONS = {
    ".java", ".py", ".js", ".jsx", ".ts", ".tsx", ".cs", ".cpp", ".c", ".h", ".go", ".rs", ".cbl", ".cob", ".cobol",
    ".sql", ".ddl", ".plsql",
    ".html", ".htm", ".css", ".scss", ".less", ".jsp", ".jsf", ".xhtml",
    ".xml", ".yaml", ".yml", ".json", ".properties", ".toml", ".ini", ".cfg", ".gradle", ".sbt",
    ".sh", ".bash", ".bat", ".ps1",
    ".md", ".txt", ".rst",
}
IMPORTANT_FILES = {
    "pom.xml", "build.gradle", "build.gradle.kts", "package.json", "web.xml", "application.properties", "application.yml",
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile", "CMakeLists.txt", "Cargo.toml", "go.mod", "go.sum",
    "requirements.txt", "setup.py", "pyproject.toml", ".gitignore", "tsconfig.json", "webpack.config.js", "vite.config.ts",
}
SKIP_DIRS = {".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", ".settings", "target", "build", "dist", "out", "bin", "obj", ".gradle", ".mvn"}
BINARY_EXTENSIONS = {
    ".class", ".jar", ".war", ".ear", ".exe", ".dll", ".so", ".dylib", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".bmp", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".woff", ".woff2", ".ttf", ".eot", ".pyc", ".pyo",
}
# Languages by extension.
LANGUAGES = {
    ".java": "Java", ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".cs": "C#", ".cpp": "C++", ".c": "C", ".h": "C/C++", ".go": "Go", ".rs": "Rust",
    ".cbl": "COBOL", ".cob": "COBOL", ".cobol": "COBOL", ".sql": "SQL", ".ddl": "SQL", ".plsql": "PL/SQL",
    ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".less": "LESS", ".jsp": "JSP", ".jsf": "JSF", ".xhtml": "XHTML",
    ".xml": "XML", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".properties": "Properties", ".toml": "TOML", ".ini": "INI",
    ".gradle": "Gradle", ".sh": "Shell", ".bash": "Shell", ".bat": "Batch", ".ps1": "PowerShell", ".md": "Markdown",
}

SCHEMA = "path string, filename string, extension string, language string, size long, loc long, content string"
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 2000


def extension(name: str) -> str:
    """The last extension in lower case, with its dot; a name that only begins with a dot has none."""
    return os.path.splitext(name)[1].lower()


def relevant(name: str) -> bool:
    ext = extension(name)
    return ext not in BINARY_EXTENSIONS and (name in IMPORTANT_FILES or ext in SUPPORTED_EXTENSIONS)


def language_of(name: str) -> str:
    return "Dockerfile" if name == "Dockerfile" else LANGUAGES.get(extension(name), "Other")


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), os.path.abspath(root)


def walk(system: pafs.FileSystem, root: str, skipped: frozenset[str]) -> Iterator[tuple[str, int]]:
    """(path from root, size) of the relevant files, in order of path within a folder; skipped folders are not listed."""
    todo = [root]
    while todo:
        inside = sorted(system.get_file_info(pafs.FileSelector(todo.pop())), key=lambda x: x.path)
        for x in inside:
            if x.type == pafs.FileType.File and relevant(x.base_name):
                yield x.path[len(root) :].lstrip("/"), x.size or 0
        todo += [x.path for x in reversed(inside) if x.type == pafs.FileType.Directory and x.base_name not in skipped]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("partitionfiles", PARTITION_FILES))
        self.skipped = frozenset(options["skipped"].split(",")) if "skipped" in options else frozenset(SKIP_DIRS)

    def partitions(self) -> list[Files]:
        system, root = filesystem(self.root)
        if system.get_file_info(root).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder at {self.root}")
        out: list[Files] = []
        held, size = [], 0
        for path, n in walk(system, root, self.skipped):
            if held and (size + n > self.most[0] or len(held) >= self.most[1]):
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(self.root)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]
        for path in partition.paths:
            try:
                with system.open_input_stream(f"{root}/{path}") as f:
                    raw = f.read()
            except OSError:
                raw = b""
            text = raw.decode("utf-8", errors="ignore")
            name = path.rsplit("/", 1)[-1]
            loc = sum(1 for line in re.split(r"\r\n|\r|\n", text) if line.strip())
            row = (path, name, extension(name), language_of(name), len(raw), loc, text)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root), options partitionBytes, partitionFiles, skipped (names of folders, parted by commas)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, skipped: tuple[str, ...] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """SCHEMA: one row for each relevant file below root, with its path from there.

    Bytes that aren't UTF-8 are dropped; a file that can't be read is empty.  A root
    that isn't a folder raises when it is read.  loc are the lines that aren't blank.
    """
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("partitionBytes", str(partition_bytes))
    return (reader if skipped is None else reader.option("skipped", ",".join(skipped))).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files (path, content) below root, each in the task that has it; null contents are empty files, and a file that is there is replaced.

    A path that leads out of root raises, and so does a null one."""

    def write(batches):
        system, top = filesystem(root)
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path is None or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not a path below the root: {path!r}")
                folder = f"{top}/{path}".rsplit("/", 1)[0]
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{top}/{path}") as f:
                    f.write((content or "").encode())
        yield from ()

    files.select("path", "content").mapInArrow(write, "none int").write.format("noop").mode("overwrite").save()
