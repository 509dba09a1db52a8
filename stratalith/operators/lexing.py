"""Source files as trees of units: one scan over tokens, with a stack of scopes.

A unit is a block (what stands before an opening brace or a colon, and all up to its
end) or a statement.  Comments are gone from a unit's head, and each string is replaced
by "n", its number in the unit's strings; so braces, names and keywords in strings and
comments count for nothing, and a pattern over heads finds code alone.  What comes after
the scan (names, routes, long methods) is left to DataFrame operators over units.

Null contents give no units; a file of an unknown language gives none; what is never
closed ends with its file.  Regular expressions between slashes aren't told from divisions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = "path string, language string, unit int, parent int, depth int, kind string, start_line int, end_line int, head string, strings array<string>"
#: Languages by extension, as far as they can be scanned.
EXTENSIONS = {"java": "Java", "kt": "Java", "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "cs": "C#", "go": "Go", "sql": "SQL", "ddl": "SQL", "cbl": "COBOL", "cob": "COBOL"}

#: Units are handed on when there are so many, or when so many characters have been scanned.
BATCH_UNITS, BATCH_TEXT = 10_000, 4_000_000

_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z)|"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
_BRACED = re.compile(rf"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>{_TRIPLE}{_QUOTED}|`(?:\\.|[^`\\])*`?)|(?P<b>[{{}}();\[\]\n])|(?P<t>[^/\"'`{{}}();\[\]\n]+|/)", re.DOTALL)
_INDENTED = re.compile(rf"(?P<c>#[^\n]*|\\\n)|(?P<s>[rbfuRBFU]{{0,2}}(?:{_TRIPLE}{_QUOTED}))|(?P<b>[{{}}()\[\]\n])|(?P<t>(?:[^#\"'{{}}()\[\]\n\\rbfuRBFU]++|[rbfuRBFU](?![rbfuRBFU]?[\"']))++|.)", re.DOTALL)
_SQL = re.compile(r"(?P<c>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>'(?:''|[^'])*'?|\"[^\"\n]*\"?)|(?P<b>[();\n])|(?P<t>[^-/'\"();\n]+|[-/])", re.DOTALL)
#: A brace opens a block of JavaScript after these, and an object after anything else.
_BLOCK_JS = re.compile(r"(?:\)|=>|\)\s*:[^={]*|\b(?:try|else|do|finally|static)|\b(?:class|interface|enum|namespace|module)\b[^=;]*)\s*$")
_ENDS_LINE = re.compile(r"[,(=&|+.?:{\[<>*]$")


class _Units:
    """Units as rows (parent, depth, kind, start_line, end_line, head, strings), and the head that is being read."""

    def __init__(self):
        self.rows: list[list] = []
        self.open: list[int] = []
        self.clear()

    def clear(self):
        self.parts: list[str] = []
        self.strings: list[str] = []
        self.start = self.segment = 0

    def add(self, part: str, line: int):
        if not self.parts:
            if not part.strip():
                return
            self.start = line
        self.parts.append(part)

    def string(self, token: str, line: int):
        body = token.lstrip("rbfuRBFU")
        quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
        body = body[len(quote) :].removesuffix(quote)
        self.add(f'"{len(self.strings)}"', line)
        self.strings.append(body)

    def last(self) -> str:
        """The logical line that is being read."""
        return "".join(self.parts[self.segment :]).strip()

    def flush(self, kind: str, line: int) -> None:
        head = " ".join("".join(self.parts).split())
        if head or kind == "block":
            self.rows.append([self.open[-1] if self.open else None, len(self.open), kind, self.start or line, line, head, self.strings])
            if kind == "block":
                self.open.append(len(self.rows) - 1)
        self.clear()

    def close(self, line: int) -> None:
        if self.open:
            self.rows[self.open.pop()][4] = line


def braced(text: str, language: str) -> list[list]:
    """Units of a language with braces."""
    u, line, brackets, outer = _Units(), 1, [], []
    scripted, by_line = language in ("JavaScript", "TypeScript"), language in ("JavaScript", "TypeScript", "Go")
    for m in _BRACED.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "t":
            u.add(token, line)
        elif token == "\n":
            if u.parts:
                if by_line and not brackets:
                    last = u.last()
                    if last.startswith("@"):
                        u.parts.append(" ")
                        u.segment = len(u.parts)
                    elif last and not _ENDS_LINE.search(last):
                        u.flush("statement", line)
                if u.parts:
                    u.parts.append(" ")
            line += 1
        elif kind == "c":
            u.add(" ", line)
            line += token.count("\n")
        elif kind == "s":
            u.string(token, line)
            line += token.count("\n")
        elif token == "{":
            last = u.last()
            block = bool(_BLOCK_JS.search(last)) or not last if scripted else not brackets and not last.endswith("=")
            if block:
                u.flush("block", line)
                outer.append(brackets)
                brackets = []
            else:
                u.add(token, line)
                brackets.append(token)
        elif token == "}":
            if "{" in brackets:
                while brackets.pop() != "{":
                    pass
                u.add(token, line)
            else:
                u.flush("statement", line)
                u.close(line)
                brackets = outer.pop() if outer else []
        elif token == ";" and not brackets:
            u.flush("statement", line)
        elif token in "([":
            brackets.append(token)
            u.add(token, line)
        else:
            if token in ")]" and brackets and brackets[-1] != "{":
                brackets.pop()
            if u.parts or token == ";":
                u.add(token, line)
    return _ended(u, line)


def indented(text: str, language: str = "Python") -> list[list]:
    """Units of a language whose blocks are set in."""
    u, line, depth, indent, last_line, indents = _Units(), 1, 0, 0, 0, []
    at_start = True

    def flush():
        nonlocal last_line
        while indents and indent <= indents[-1]:
            u.close(last_line)
            indents.pop()
        block = u.last().endswith(":")
        u.flush("block" if block else "statement", line)
        last_line = line
        if block:
            indents.append(indent)

    for m in _INDENTED.finditer(text):
        kind, token = m.lastgroup, m.group()
        if at_start and kind in "st" and token.strip():
            first = len(m.string[m.string.rfind("\n", 0, m.start()) + 1 : m.start()]) + len(token) - len(token.lstrip())
            indent = indent if u.parts else first
            at_start = False
        if kind == "t":
            u.add(token, line)
        elif kind == "s":
            u.string(token, line)
            line += token.count("\n")
        elif token == "\n":
            if depth == 0 and u.parts:
                if u.last().startswith("@"):
                    u.parts.append(" ")
                    u.segment = len(u.parts)
                else:
                    flush()
                at_start = True
            if u.parts:
                u.parts.append(" ")
            line += 1
        elif kind == "b":
            depth = depth + 1 if token in "([{" else max(0, depth - 1)
            u.add(token, line)
        else:
            line += token.count("\n")
    if u.parts:
        flush()
    return _ended(u, last_line)


def statements(text: str, language: str = "SQL") -> list[list]:
    """Statements up to their semicolons; brackets make no scopes."""
    u, line = _Units(), 1
    for m in _SQL.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "s":
            u.string(token, line)
        elif token == ";":
            u.flush("statement", line)
        else:
            u.add(" " if kind == "c" else token, line)
        line += token.count("\n")
    return _ended(u, line)


def sentences(text: str, language: str = "COBOL") -> list[list]:
    """Lines, without those that an asterisk in column seven makes comments; embedded SQL up to its end is one."""
    u, own, embedded = _Units(), True, False
    for k, line in enumerate(text.split("\n"), 1):
        if line[6:7] == "*":
            continue
        if not embedded:
            own = line[7:8].strip() != ""  # column eight tells a paragraph from what it holds
        for m in re.finditer(rf"(?P<s>{_QUOTED})|(?P<t>[^\"']+)", line):
            u.string(m.group(), k) if m.lastgroup == "s" else u.add(m.group(), k)
        embedded = (embedded or "EXEC SQL" in line.upper()) and "END-EXEC" not in line.upper()
        if embedded:
            u.add(" ", k)
            continue
        before = len(u.rows)
        u.flush("statement", k)
        for row in u.rows[before:]:
            row[1] = 0 if own else 1
    return _ended(u, text.count("\n") + 1)


def _ended(u: _Units, line: int) -> list[list]:
    if u.parts:
        u.flush("statement", line)
    while u.open:
        u.close(line)
    return u.rows


SCANNERS = {"Java": braced, "C#": braced, "Go": braced, "JavaScript": braced, "TypeScript": braced, "Python": indented, "SQL": statements, "COBOL": sentences}


def language_of(path: str | Column) -> Column:
    """A language that can be scanned, by the path's extension; else null."""
    names = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return names[F.lower(F.regexp_extract(path, r"[.]([A-Za-z0-9]+)$", 1))]


def units_of(path: str, language: str, text: str) -> Iterator[tuple]:
    for k, (parent, depth, kind, a, b, head, strings) in enumerate(SCANNERS[language](text.replace("\r\n", "\n"), language)):
        yield path, language, k, parent, depth, kind, a, b, head, strings


def code_units(files: DataFrame) -> DataFrame:
    """UNITS of files (path, content); paths should be unique, as parents are found by path and number."""
    known = files.select("path", language_of("path").alias("language"), "content").filter("language is not null and content is not null")
    names = ["path", "language", "unit", "parent", "depth", "kind", "start_line", "end_line", "head", "strings"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def scan(batches):
        rows, size = [], 0
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += units_of(path, language, text)
                size += len(text)
                if len(rows) >= BATCH_UNITS or size >= BATCH_TEXT:
                    if rows:
                        yield as_batch(rows)
                    rows, size = [], 0
        if rows:
            yield as_batch(rows)

    return known.mapInArrow(scan, UNITS)
