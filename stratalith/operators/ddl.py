"""Tables, columns, keys and indexes of SQL DDL, by tokens, so that nested parentheses, strings and comments are safe."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, table_name string, ordinal int, name string, type string, length int, scale int, nullable boolean, primary_key boolean, auto_increment boolean, is_unique boolean, columns array<string>, ref_table string, ref_columns array<string>, on_delete string"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("table_name", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("length", pa.int32()), ("scale", pa.int32()), ("nullable", pa.bool_()), ("primary_key", pa.bool_()), ("auto_increment", pa.bool_()), ("is_unique", pa.bool_()), ("columns", pa.list_(pa.string())), ("ref_table", pa.string()), ("ref_columns", pa.list_(pa.string())), ("on_delete", pa.string())])
_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"[^"]*"|`[^`]*`|\[[^\]]*\]|\w+|\S""", re.S)


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def bare(t: str) -> str:
    return t.strip('"`[]')


def closing(toks: list[str], at: int) -> int:
    """Where the parenthesis that opens at `at` closes; the end if it never does."""
    depth = 0
    for i in range(at, len(toks)):
        depth += (toks[i] == "(") - (toks[i] == ")")
        if not depth:
            return i
    return len(toks)


def split_top(toks: list[str]) -> list[list[str]]:
    """Parts between commas that are in no parentheses."""
    parts, depth = [[]], 0
    for t in toks:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def name_at(toks: list[str], at: int) -> tuple[str, int]:
    """The last part of a qualified name, and the place after it."""
    name, at = bare(toks[at]) if at < len(toks) else "", at + 1
    while at + 1 < len(toks) and toks[at] == ".":
        name, at = bare(toks[at + 1]), at + 2
    return name, at


def names_in(toks: list[str], at: int) -> list[str]:
    if at >= len(toks) or toks[at] != "(":
        return []
    return [bare(p[0]) for p in split_top(toks[at + 1 : closing(toks, at)])]


def reference(toks: list[str], up: list[str]) -> dict:
    if "REFERENCES" not in up:
        return {}
    table, at = name_at(toks, up.index("REFERENCES") + 1)
    out = {"ref_table": table, "ref_columns": names_in(toks, at), "on_delete": "RESTRICT"}
    for i in range(at, len(up) - 2):
        if up[i : i + 2] == ["ON", "DELETE"]:
            out["on_delete"] = " ".join(up[i + 2 : i + 4]) if up[i + 2] in ("SET", "NO") else up[i + 2]
    return out


def part_row(toks: list[str]) -> dict:
    """A column or a constraint of a table's body."""
    up = [t.upper() for t in toks]
    name = None
    if up[0] == "CONSTRAINT":
        name, at = name_at(toks, 1)
        toks, up = toks[at:], up[at:]
    head = up[0] if up else ""
    brace = up.index("(") if "(" in up else len(up)
    if up[:2] == ["PRIMARY", "KEY"]:
        return {"kind": "primary key", "name": name, "columns": names_in(toks, brace)}
    if up[:2] == ["FOREIGN", "KEY"]:
        return {"kind": "foreign key", "name": name, "columns": names_in(toks, brace)} | reference(toks, up)
    if head == "CHECK":
        return {"kind": "check", "name": name}
    if head in ("UNIQUE", "INDEX", "KEY") and (brace < len(up)):
        words = [t for t, u in zip(toks[:brace], up[:brace], strict=True) if u not in ("UNIQUE", "INDEX", "KEY")]
        return {"kind": "index", "name": name or (bare(words[0]) if words else None), "columns": names_in(toks, brace), "is_unique": head == "UNIQUE"}
    kind = up[1] if len(up) > 1 else None
    size = [int(t) for t in toks[3 : closing(toks, 2)] if t.isdigit()] if len(toks) > 2 and toks[2] == "(" else []
    pairs = list(zip(up, up[1:], strict=False))
    key = ("PRIMARY", "KEY") in pairs
    return {
        "kind": "column", "name": bare(toks[0]), "type": kind, "length": size[0] if size else None, "scale": size[1] if len(size) > 1 else None,
        "nullable": not key and ("NOT", "NULL") not in pairs, "primary_key": key, "is_unique": key or "UNIQUE" in up,
        "auto_increment": (kind or "").endswith("SERIAL") or bool({"AUTO_INCREMENT", "AUTOINCREMENT", "IDENTITY"} & set(up)),
    } | reference(toks, up)


def parsed(sql: str | None):
    """Rows (as dicts) of a text; statements that aren't DDL are passed over."""
    toks = tokens(sql or "")
    up = [t.upper() for t in toks]
    i = 0
    while i < len(toks):
        if up[i] != "CREATE":
            i += 1
            continue
        words, j = [], i + 1
        while j < len(toks) and up[j] in ("OR", "REPLACE", "TEMPORARY", "TEMP", "UNIQUE", "MATERIALIZED", "TABLE", "INDEX", "VIEW", "PROCEDURE", "FUNCTION", "TRIGGER", "IF", "NOT", "EXISTS"):
            words.append(up[j])
            j += 1
        name, j = name_at(toks, j)
        kind = next((k for k in ("TABLE", "INDEX", "VIEW", "PROCEDURE", "FUNCTION", "TRIGGER") if k in words), None)
        if kind == "TABLE":
            yield {"kind": "table", "table_name": name, "name": name, "ordinal": 0}
            if j < len(toks) and toks[j] == "(":
                end = closing(toks, j)
                for n, part in enumerate(split_top(toks[j + 1 : end]), 1):
                    yield {"table_name": name, "ordinal": n} | part_row(part)
                j = end
        elif kind == "INDEX" and j < len(toks) and up[j] == "ON":
            table, j = name_at(toks, j + 1)
            yield {"kind": "index", "table_name": table, "name": name, "columns": names_in(toks, j), "is_unique": "UNIQUE" in words}
        elif kind:
            yield {"kind": kind.lower(), "name": name}
        i = max(j, i + 1)


def ddl_objects(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each table, column, key, index, view, procedure, function and trigger; null and empty texts give none."""

    def parse(batches):
        for batch in batches:
            rows = [{"path": p, **r} for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in parsed(t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select(path, content).mapInArrow(parse, SCHEMA)
