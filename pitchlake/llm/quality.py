"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built-in column functions over one row, so no text moves and
nothing is shuffled.

Defined results: a null text counts as empty, has no words and fails; a very long
text is judged whole, in its row; a measure at a threshold passes; repeated
rows are each judged; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import id_text

#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this at from or an not have which".split(),
    "de": "der die und das in zu den ist von mit sich des auf für nicht ein eine als auch es dem im".split(),
    "fr": "le la les de des et en un une que qui est pour dans par sur au avec pas du ce il elle".split(),
    "es": "el la los las de que y en un una es por con no se para al del lo como más".split(),
}
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose measure lies between low and high (either may be open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("exclamations", "n_bangs / n_words", None, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.4),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every rule holds."""
    ok = F.lit(True)
    for r in rules:
        x = F.expr(f"try_divide({', '.join(r.measure.split(' / '))})")
        if r.low is not None:
            ok &= F.coalesce(x >= r.low, F.lit(False))
        if r.high is not None:
            ok &= F.coalesce(x <= r.high, F.lit(False))
    return ok


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: windows are sorted within the row, equal neighbours repeat."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    return F.sort_array(windows)


def covered(places: Column) -> Column:
    """Words in the 3-word windows that start at the sorted places."""
    step = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts that the rules use, per document."""
    t = F.col("t")
    has_word = lambda x: F.trim(F.translate(x, WHITE, "      ")) != ""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = df.select("doc_id", "t", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("words"), F.filter(F.split(t, "\n"), has_word).alias("lines"))
    df = df.withColumn("windows", repeated_words(F.col("words")))
    df = df.withColumn("again", F.filter("windows", lambda x, k: (x["w"] == F.get("windows", k - 1)["w"]) | (x["w"] == F.get("windows", k + 1)["w"])))
    df = df.withColumn("places", F.sort_array(F.transform("again", lambda x: x["i"])))
    length = lambda c: F.length(c).cast("long")
    return df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        length(F.translate(t, WHITE, "")).alias("word_chars"),
        (length(t) - length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("places")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (length(t) - length(F.replace(t, F.lit("!"), F.lit("")))).alias("n_bangs"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measures() with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


_W = "string_split_regex(t, '[\\x20\\x09-\\x0D]+')"
_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter({_W}, lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {_WHITE_SQL}, '') <> '') AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(translate(t, {_WHITE_SQL}, '')) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_bangs,
             len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted({w for ws in STOP_WORDS.values() for w in ws}))}))) AS n_stop_words,
             len(list_filter(lines, lambda x: ltrim(x)[1:1] IN ('-', '*', '•'))) AS n_bullet_lines,
             len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis_lines
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({r.measure.replace(' / ', '::DOUBLE / nullif(')}, 0) {op} {x}, false)" for r in RULES for op, x in ((">=", r.low), ("<=", r.high)) if x is not None)} AS kept
FROM f
"""
