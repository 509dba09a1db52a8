"""Source code cut at definitions, and put together again.  Arrow batches where folding over lines needs it.

Null contents give no chunks; paths may repeat.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = "path string, chunk int, kind string, name string, start_line int, end_line int, body string"
BOUNDARY = re.compile(r"\s*(?:(?:(?:public|private|protected|static|async)\s+)*(?:class|def|function|interface|enum|struct|record)\s+\w|//|#)")


def by_size(text: str, most: int) -> Iterator[tuple[str, int, int]]:
    """(body, first line, last line): a cut before a definition or comment once a line would pass `most`; a piece 1.2 times as long is cut at any line."""

    def pieces(lines: list[str], first: int, may_cut: Callable[[str], bool]):
        held, size, at = [], 0, first
        for k, line in enumerate(lines, first):
            if held and size + len(line) > most and may_cut(line):
                yield held, at
                held, size, at = [], 0, k
            held.append(line)
            size += len(line)
        if held:
            yield held, at

    for held, at in pieces(text.splitlines(keepends=True), 1, lambda line: bool(BOUNDARY.match(line))):
        whole = sum(map(len, held)) <= most * 1.2 or len(text) <= most
        for part, start in [(held, at)] if whole else pieces(held, at, lambda line: True):
            yield "".join(part), start, start + len(part) - 1


def python_parts(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of imports, classes and top-level functions, by the syntax tree; of a text that isn't Python, nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for x in tree.body:
        start = min([x.lineno, *(d.lineno for d in getattr(x, "decorator_list", []))])
        if isinstance(x, ast.Import | ast.ImportFrom):
            yield "imports", "", start, x.end_lineno
        elif isinstance(x, ast.ClassDef):
            yield "class", x.name, start, x.end_lineno
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            yield "function", x.name, start, x.end_lineno


HEADS = {
    "java": (re.compile(r"\s*(package|import)\s"), re.compile(r"\s*(?:(?:public|protected|private|abstract|final|static)\s+)*(class|interface|enum|record)\s+(\w+)")),
    "javascript": (re.compile(r"\s*import\s|.*\brequire\("), re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|function)\s+(\w+)|\s*(?:export\s+)?(const)\s+(\w+)\s*=\s*(?:async\s*)?\(")),
}


def braced_parts(text: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of imports and of definitions up to their closing brace, for languages with braces."""
    lines, heads = text.split("\n"), HEADS[language]
    k = 0
    while k < len(lines):
        if heads[0].match(lines[k]):
            yield "imports", "", k + 1, k + 1
        elif m := heads[1].match(lines[k]):
            kind, name = (x for x in m.groups() if x)
            depth, seen, end = 0, False, k
            while end < len(lines):
                depth += lines[end].count("{") - lines[end].count("}")
                seen |= "{" in lines[end]
                if depth <= 0 and (seen or lines[end].rstrip().endswith(";")):
                    break
                end += 1
            end = min(end, len(lines) - 1)
            yield "class" if kind in ("class", "interface", "enum", "record") else "function", name, k + 1, end + 1
            k = end
        k += 1


def parts_of(path: str, text: str) -> list[tuple[str, str, int, int]]:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "py":
        return list(python_parts(text))
    if ext in ("java", "kt"):
        return list(braced_parts(text, "java"))
    return list(braced_parts(text, "javascript")) if ext in ("js", "jsx", "ts", "tsx") else []


def structured(path: str, text: str, window: int = 50) -> Iterator[tuple[str, str, int, int, str]]:
    """Chunks of a file: runs of imports, definitions, what they leave, and windows of lines for a file without any."""
    lines, found = text.split("\n"), parts_of(path, text)
    if not found:
        for a in range(0, len(lines), window):
            if body := "\n".join(lines[a : a + window]):
                yield "generic", "", a + 1, min(a + window, len(lines)), body
        return
    spans: list[tuple[str, str, int, int]] = []
    for kind, name, a, b in sorted(found, key=lambda x: x[2]):
        if kind == "imports" and spans and spans[-1][0] == "imports" and spans[-1][3] + 1 >= a:
            spans[-1] = ("imports", "", spans[-1][2], max(b, spans[-1][3]))
        else:
            spans.append((kind, name, a, b))
    at = 1
    for kind, name, a, b in [*spans, ("", "", len(lines) + 1, 0)]:
        rest = "\n".join(lines[at - 1 : a - 1])
        if a > at and rest.strip():
            yield "remaining", "", at, a - 1, rest
        if kind:
            yield kind, name, a, b, "\n".join(lines[a - 1 : b])
        at = max(at, b + 1)


def _chunked(files: DataFrame, cut: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(path, k, *row) for k, row in enumerate(cut(path or "", text))] if text is not None else []
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            names = ["path", "chunk", "kind", "name", "start_line", "end_line", "body"]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, CHUNKS)


def code_chunks(files: DataFrame, window: int = 50) -> DataFrame:
    """CHUNKS of files (path, content): Python by its syntax tree, Java and JavaScript by braces, anything else by windows of lines."""
    return _chunked(files, lambda path, text: structured(path, text, window))


def transform_chunks(files: DataFrame, most: int = 20_000) -> DataFrame:
    """CHUNKS of about `most` characters, cut at definitions; a line longer than that stays whole."""
    return _chunked(files, lambda path, text: (("piece", "", a, b, body) for body, a, b in by_size(text, most)))


def reassembled(chunks: DataFrame) -> DataFrame:
    """(path, content): chunks (path, chunk, body) joined by a blank line, without the imports of those after the first."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    heads = F.when(ext.isin("java", "kt"), F.lit(r"^\s*(package|import) ")).when(ext == "py", F.lit(r"^\s*(import|from) "))
    ended = F.regexp_replace("body", r"\n\z", "")  # the last line's end begins no line
    own = F.array_join(F.filter(F.split(ended, "\n"), lambda line: ~F.regexp(line, heads)), "\n")
    body = F.when((F.col("chunk") == 0) | heads.isNull(), F.col("body")).otherwise(own)
    parts = chunks.select("path", "chunk", body.alias("body")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk", "body"))).alias("parts"))
    return parts.select("path", F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n").alias("content"))


def split_parameters(text: str | Column) -> Column:
    """Parts of a parameter list at the commas outside round and square brackets, trimmed; a last empty part goes.

    A comma stands outside if the text before it has as many opening as closing brackets of each kind.
    """
    c = F.col(text) if isinstance(text, str) else text
    pieces = F.split(c, ",")
    count = lambda s, mark: F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))
    level = lambda s: (count(s, "[") == count(s, "]")) & (count(s, "(") == count(s, ")"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("within"))

    def add(acc, piece):
        whole = F.when(acc["within"], F.concat(acc["open"], F.lit(","), piece)).otherwise(piece)
        ends = level(whole)
        done = F.when(ends, F.concat(acc["done"], F.array(F.trim(whole)))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(ends, F.lit("")).otherwise(whole).alias("open"), (~ends).alias("within"))

    def finish(acc):
        out = F.when(acc["within"] & (F.trim(acc["open"]) != ""), F.concat(acc["done"], F.array(F.trim(acc["open"])))).otherwise(acc["done"])
        return F.when(F.element_at(out, -1) == "", F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)

    return F.aggregate(pieces, start, add, finish)


#: Where a parameter with such an annotation comes from.
PLACES = {"RequestParam": "query", "PathVariable": "path", "RequestBody": "body", "RequestHeader": "header"}


def annotated_parameters(methods: DataFrame, key: str, parameters: str) -> DataFrame:
    """(key, ordinal, name, type, location) of annotated parameters in Java parameter lists."""
    each = methods.select(key, F.posexplode(split_parameters(parameters)).alias("ordinal", "text"))
    pattern = rf"@({'|'.join(PLACES)})(?:\((?:[^()]|\([^()]*\))*\))?\s+([\w<>\[\], ]*[\w>\]])\s+(\w+)\s*$"
    part = lambda k: F.regexp_extract("text", pattern, k)
    place = F.lit(None).cast("string")
    for mark, where in PLACES.items():
        place = F.when(part(1) == mark, F.lit(where)).otherwise(place)
    return each.select(key, "ordinal", part(3).alias("name"), part(2).alias("type"), place.alias("location")).filter("location is not null")


def route_parameters(routes: DataFrame, key: str, route: str) -> DataFrame:
    """(key, ordinal, name, type, location) of the parameters in a route: <int:id> or <id>, {id} and :id."""
    found = F.regexp_extract_all(F.col(route), F.lit(r"(<(?:\w+:)?\w+>|\{\w+(?::\w+)?\}|(?<=/):\w+)"), F.lit(1))
    each = routes.select(key, F.posexplode(found).alias("ordinal", "text"))
    bare = F.regexp_replace("text", r"[<>{}]|^:", "")
    angle = F.col("text").startswith("<") & F.col("text").contains(":")
    name = F.when(angle, F.substring_index(bare, ":", -1)).otherwise(F.substring_index(bare, ":", 1))
    kind = F.when(angle, F.substring_index(bare, ":", 1)).otherwise(F.lit("string"))
    return each.select(key, "ordinal", name.alias("name"), kind.alias("type"), F.lit("path").alias("location"))


def model_fields(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, model, ordinal, name, type) of the fields in Python model classes and Java classes' private fields, in order of lines."""
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("ordinal", "line"))
    from pyspark.sql import Window as W

    head = F.regexp_extract("line", r"^\s*(?:public\s+)?class\s+(\w+)", 1)
    named = lines.withColumn("model", F.last(F.when(head != "", head), ignorenulls=True).over(W.partitionBy(key).orderBy("ordinal")))
    py, java = r"^\s+(\w+)\s*:\s*([\w\[\], |.]+?)\s*(?:=.*)?$", r"^\s*(?:private|protected)\s+(?:final\s+)?([\w<>, ]+?)\s+(\w+)\s*(?:=.*)?;"
    name = F.when(F.regexp("line", F.lit(java)), F.regexp_extract("line", java, 2)).otherwise(F.regexp_extract("line", py, 1))
    kind = F.when(F.regexp("line", F.lit(java)), F.regexp_extract("line", java, 1)).otherwise(F.regexp_extract("line", py, 2))
    return named.select(key, "model", "ordinal", name.alias("name"), kind.alias("type")).filter("model is not null and name <> ''")
