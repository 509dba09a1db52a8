"""Symbols of Python sources by the standard syntax tree."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, name string, parent string, line int, last_line int, args array<string>, decorators array<string>, complexity int"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("line", pa.int32()), ("last_line", pa.int32()), ("args", pa.list_(pa.string())), ("decorators", pa.list_(pa.string())), ("complexity", pa.int32())])


def complexity(node: ast.AST) -> int:
    """One, and one for each branch, loop, handler and further operand of and / or."""
    branches = sum(isinstance(n, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler)) for n in ast.walk(node))
    return 1 + branches + sum(len(n.values) - 1 for n in ast.walk(node) if isinstance(n, ast.BoolOp))


def symbols(source: str | None):
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        yield {"kind": "error", "name": type(e).__name__, "line": getattr(e, "lineno", None)}
        return
    yield {"kind": "module", "complexity": complexity(tree)}
    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            module = getattr(n, "module", None)
            for a in n.names:
                yield {"kind": "import", "name": a.name, "parent": module, "line": n.lineno}
    homes = [(None, tree)] + [(n.name, n) for n in tree.body if isinstance(n, ast.ClassDef)]
    for home, body in homes:
        for n in body.body:
            where = {"line": getattr(n, "lineno", None), "last_line": getattr(n, "end_lineno", None)}
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield {"kind": "method" if home else "function", "name": n.name, "parent": home, "args": [a.arg for a in n.args.args], "decorators": [ast.unparse(d) for d in n.decorator_list], "complexity": complexity(n), **where}
            elif isinstance(n, ast.ClassDef) and not home:
                yield {"kind": "class", "name": n.name, "decorators": [ast.unparse(d) for d in n.decorator_list], "args": [ast.unparse(b) for b in n.bases], "complexity": complexity(n), **where}


def python_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each module, import, class, method and function; a text that can't be parsed gives one row of kind error."""

    def parse(batches):
        for batch in batches:
            rows = [{"path": p, **r} for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in symbols(t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select(path, content).mapInArrow(parse, SCHEMA)
