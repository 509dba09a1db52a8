"""Line-first cleaning, in DataFrame functions alone.

Rules judge each line; lines that fail are removed; a document that loses more
than half of its characters (of lines with words) is rejected.  Base rules on
length and repetition come on top.  All of it happens within a row, without a
shuffle; repeated windows are found by sorting hashes of the row's own windows.

Null or empty text has no words and fails the base rules; rows with equal doc_id
are judged each by itself; a null doc_id is kept as it is; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
MOST_LOST = 50  # per cent of the characters
# Phrases of navigation and boilerplate, in lower case.
BOILERPLATE = ("lorem ipsum", "javascript", "enable cookies", "use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "sign in", "log in", "subscribe now", "read more", "back to top", "skip to content")
TERMINAL = r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def count_of(text: Column, characters: str) -> Column:
    """How many of these characters a text has; replace() looks for bytes, and is faster than translate() by characters."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def letters_in(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule."""

    def has_phrase(low: Column) -> Column:
        found = low.contains(BOILERPLATE[0])
        for p in BOILERPLATE[1:]:
            found = found | low.contains(p)
        return found

    # exists() over one element: what is made of the line is made once for all rules
    phrase = F.exists(F.array(F.lower(line)), has_phrase)

    def broken(words: Column) -> Column:
        n = F.size(words)
        symbols = count_of(line, SYMBOLS) * 10 > F.greatest(letters_in(words), F.lit(1))
        navigation = (count_of(line, "|") > 2) | ((n <= 12) & (count_of(line, "›»>/") > 2))
        shouting = (n > 2) & (count_of(line, "!") * 4 > n * 2)
        repeated = (n >= 10) & (F.size(F.array_distinct(words)) * 5 <= n)
        unfinished = (n >= 12) & ~line.rlike(TERMINAL)
        return F.coalesce(symbols | navigation | shouting | repeated | unfinished | phrase, F.lit(False))

    return F.exists(F.array(words_of(line)), broken)


def window_hashes(hashes: str, n: int) -> Column:
    """Hashes of the windows of n words, from those of the words."""
    each = lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(n)])
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), each)).otherwise(F.array().cast("array<bigint>"))


def line_first_cleaning(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed, chars_lost, chars, cleaned."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", text.alias("text"))
    one = one.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    one = one.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    one = one.withColumn("windows", window_hashes("hashes", WINDOW))
    # most texts repeat no window; only the others are sorted
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    one = one.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(placed)))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.filter("sorted", lambda e, i: same(e, F.get(F.col("sorted"), i + 1)) | ((i > 0) & same(e, F.get(F.col("sorted"), F.greatest(i - 1, F.lit(0))))))
    one = one.withColumn("places", F.array_sort(F.transform(twice, lambda e: e["i"])))
    # a window covers WINDOW words, or as many as lie before the next one
    spans = F.transform("places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("places"), j + 1) - p, F.lit(WINDOW) + j - j)))
    one = one.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    one = one.withColumn("good", F.filter("lines", lambda x: ~line_fails(x)))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    out = one.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        letters_in(F.col("words")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        size("lines").alias("chars"),
        (size("lines") - size("good")).alias("chars_lost"),
        F.array_join("good", "\n").alias("cleaned"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("chars_lost") * 100 <= F.col("chars") * most_lost))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_cleaning(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + {WINDOW - 1}]) AS n FROM p),
r AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM k WHERE n > 1) GROUP BY doc_id),
g AS (SELECT *, list_filter(lines, lambda x: NOT (
        10 * (length(x) - length(translate(x, '{SYMBOLS}', ''))) > greatest(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')), 1)
        OR length(x) - length(translate(x, '|', '')) > 2
        OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 12 AND length(x) - length(translate(x, '›»>/', '')) > 2)
        OR (4 * (length(x) - length(translate(x, '!', ''))) > 2 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 2)
        OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 10 AND 5 * len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) <= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
        OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 12 AND NOT regexp_matches(x, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*$'))
        OR {_PHRASES})) AS good FROM w),
s AS (SELECT g.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(good) AS BIGINT) AS n_lines_removed,
             coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS chars,
             coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS good_chars
      FROM g LEFT JOIN r ON g.doc_id = r.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (chars - good_chars) <= {MOST_LOST} * chars AS kept, n_lines, n_lines_removed FROM b
"""
