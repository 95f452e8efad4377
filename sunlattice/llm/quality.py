"""Line-first cleaning: judge every line, drop those that fail, then reject documents that lose too much text.

Everything here is a column expression over one row: no shuffle, no Python on the executors, memory bounded by the
largest single text.

Defined results: a null or empty text has no words and is rejected (base rule); repeated rows are judged alike; null
ids and null other columns pass through; an empty table gives an empty table; columns of other names are kept, and a
column of the input that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.words import SPACES, bound, has_word, lines_of, word_count, words_of

#: Fixed by contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Line rules.
ENDS = r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
SEPARATORS = r"(?:^|\s)[|•·»›>](?=\s|$)"
MAX_SEPARATORS = 3
MAX_SYMBOL_PERCENT = 10
BOILERPLATE_WORDS = 30
BOILERPLATE = (
    r"(?i)\b(?:lorem ipsum|enable javascript|cookie policy|use of cookies|terms of (?:use|service)|privacy policy|"
    r"all rights reserved|sign in|log in|click here|read more|share this|subscribe now|skip to content|"
    r"back to top|powered by)\b"
)
#: A document may lose at most this part of its words to the line rules.
MAX_LOSS_PERCENT = 50


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words (a power of two) that occurs twice or more in the text."""
    def joined(step: int):
        def pair(h: Column) -> Column:
            n = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

        return pair

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    width = 1
    while width < window:
        hashes = bound(hashes, joined(width))
        width *= 2

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bound(
            placed,
            lambda s: F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(
            starts,
            first,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word."""
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    dense = 100 * marks > MAX_SYMBOL_PERCENT * F.length(F.translate(line, SPACES, ""))
    spaced = F.concat(F.lit(" "), line)
    menu = F.size(F.split(spaced, SEPARATORS, -1)) > MAX_SEPARATORS
    stock = line.rlike(BOILERPLATE) & (word_count(line) <= BOILERPLATE_WORDS)
    return ~line.rlike(ENDS) | dense | menu | stock


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the base counts, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, clean_text (the text
    without its failing lines; blank lines stay) and kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = df.withColumn("_lines", lines_of(F.col(text))).withColumn("_words", words_of(F.col(text)))
    filled = F.filter("_lines", has_word)
    counted = lines.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": bound(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
            "_failed": F.filter("_lines", lambda x: has_word(x) & line_fails(x)),
        }
    ).drop("_words")
    ruled = counted.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
            "lost_words": word_count(F.array_join("_failed", "\n")).cast("long"),
            "clean_text": F.when(F.size("_failed") == 0, F.col(text)).otherwise(
                F.array_join(F.filter("_lines", lambda x: ~(has_word(x) & line_fails(x))), "\n")
            ),
        }
    ).drop("_lines", "_failed")
    return ruled.withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= MAX_LOSS_PERCENT * F.col("n_words"))
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM documents),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c
  FROM (SELECT r, i, list_slice(w, i, i + 7) AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
rep AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM win WHERE c > 1) GROUP BY r),
bad AS (
  SELECT r, sum(len(regexp_extract_all(x, '[^ \t-\r]+'))) AS n
  FROM (SELECT r, unnest(l) AS x FROM d)
  WHERE NOT regexp_matches(x, '[.!?…:;。！？]["''”’»)\]]*[ \t-\r]*$')
     OR 100 * (length(x) - length(translate(x, '#*$%&|<>', '')))
        > 10 * length(regexp_replace(x, '[ \t-\r]', '', 'g'))
     OR len(regexp_split_to_array(regexp_replace(' ' || x || ' ', '\s([|•·»›>])\s', chr(1) || ' ', 'g')
                                  , chr(1))) > 3
     OR (regexp_matches(x, '(?i)\b(?:lorem ipsum|enable javascript|cookie policy|use of cookies|terms of (?:use|service)|privacy policy|all rights reserved|sign in|log in|click here|read more|share this|subscribe now|skip to content|back to top|powered by)\b')
         AND len(regexp_extract_all(x, '[^ \t-\r]+')) <= 30)
  GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(bad.n, 0) AS lost
  FROM d LEFT JOIN rep USING (r) LEFT JOIN bad USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM m
"""
