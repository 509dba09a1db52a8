"""Chunks of texts by lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(files: DataFrame, key: str, content: str, lines: int) -> DataFrame:
    """(key, chunk, start_line, end_line, body): windows of so many lines without those that are blank."""
    parts = files.select(key, F.split(content, "\n").alias("lines"))
    at = F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)), F.lit(lines))
    one = parts.select(key, "lines", F.explode(at).alias("start"))
    body = F.array_join(F.slice("lines", F.col("start") + 1, F.lit(lines)), "\n")
    out = one.select(key, (F.col("start") / lines).cast("long").alias("chunk"), (F.col("start") + 1).cast("long").alias("start_line"), F.least(F.col("start") + lines, F.size("lines")).cast("long").alias("end_line"), body.alias("body"))
    return out.filter(F.trim(F.translate("body", "\n\t\r", "   ")) != "")


def overlapping(files: DataFrame, key: str, content: str, most: int = 2000, overlap: int = 4) -> DataFrame:
    """(key, chunk, body): lines gathered until a chunk would exceed `most` characters; each next chunk begins with the last `overlap` lines of the one before."""
    schema = f"{key} {dict(files.dtypes)[key]}, chunk long, body string"

    def chunk(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[content], strict=True):
                held, size, n = [], 0, 0
                for line in (text or "").split("\n"):
                    if held and size + len(line) + 1 > most:
                        rows.append((k, n, "\n".join(held)))
                        n += 1
                        held = held[-overlap:] if overlap else []
                        size = sum(len(x) + 1 for x in held)
                    held.append(line)
                    size += len(line) + 1
                if any(x.strip() for x in held):
                    rows.append((k, n, "\n".join(held)))
            yield pd.DataFrame(rows, columns=[key, "chunk", "body"])

    return files.select(key, content).mapInPandas(chunk, schema)
