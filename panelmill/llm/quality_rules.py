"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule; versioned
policies are masks over these bits, so a verdict and an ablation (what a policy would keep without one of its rules)
come from bitwise arithmetic over the ledger, without a second look at any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import spread

#: Rule name and the condition under which it fails, over the ledger's measurements. The position is the rule's bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > 6 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("many_words", "n_words > 1000000"),
]
BASE_RULES = ("few_words", "repeated_windows")
#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "short_mean_word", "long_mean_word", "symbols", "duplicate_lines"),
}
CURRENT = "v2"
_SPACE = "[\\x20\\x09-\\x0D]"
_BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(version: str) -> int:
    return sum(_BIT[name] for name in POLICIES[version])


def _repeated(windows: Column) -> Column:
    """Of sorted (window, position) pairs those equal to a neighbour, as the words they cover."""
    same = lambda s, i: F.coalesce(s["t"] == F.get(windows, i - 1)["t"], F.lit(False)) | F.coalesce(s["t"] == F.get(windows, i + 1)["t"], F.lit(False))
    hit = F.filter(windows, same)
    return F.flatten(F.transform(hit, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, measurements (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) and fail_bits.

    One row per row of docs, no shuffle but of small inputs (spread()). A null text has no words, lines or symbols, as has an empty one; both fail
    few_words. Null ids stay null; other columns are not read. Words are the runs of characters but space and
    \\t..\\r; lines are cut at \\n and count when they hold a word. With whole,
    the column row has all columns of docs.
    """
    carried = ["row"] if whole else []
    base = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if whole else [])))
    base = base.select(
        *carried,
        "doc_id",
        F.array_remove(F.split("t", f"{_SPACE}+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    base = base.select(
        *carried,
        "doc_id",
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.slice(
            F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(F.size("words") - 2, F.lit(0))
        ).alias("windows"),
    )
    sets = [*carried, "doc_id", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    base = base.select(
        *sets,
        F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("t"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<t:string,i:int>>"))
        .alias("sorted"),
    )
    base = base.select(*sets, F.size(F.array_distinct(_repeated(F.col("sorted")))).cast("bigint").alias("n_repeat_words"))
    bits = sum((F.when(F.expr(rule), F.lit(_BIT[name])).otherwise(F.lit(0)) for name, rule in RULES), F.lit(0))
    return base.select("*", bits.cast("bigint").alias("fail_bits"))


def verdicts(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with kept, true where no rule of the policy failed."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0)


def keep(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of the ledger that the policy keeps.

    The array of one struct keeps the optimiser from moving the filter below the ledger, where each of its conditions
    would evaluate the measurements again. So filter a ledger by this, or write it first.
    """
    entries = book.select(F.explode_outer(F.array(F.struct(*book.columns))).alias("entry"))
    return entries.where(F.col("entry.fail_bits").bitwiseAND(F.lit(mask(version))) == 0).select("entry.*")


def kept_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs, with all their columns, that the policy keeps. Null and empty texts fail few_words; repeated rows stay or go together; ids are not looked at; an empty table gives no rows."""
    return keep(ledger(docs, whole=True).select("row", "fail_bits"), version).select("row.*")


def ablations(book: DataFrame) -> DataFrame:
    """policy, without (a rule, or null for the whole policy), n_kept: one pass over the ledger's distinct bit patterns."""
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [(v, None, mask(v)) for v in POLICIES] + [(v, rule, mask(v) & ~_BIT[rule]) for v in POLICIES for rule in POLICIES[v]]
    sums = [F.sum(F.when(F.col("fail_bits").bitwiseAND(F.lit(m)) == 0, F.col("n")).otherwise(0)).cast("bigint").alias(f"k{i}") for i, (_, _, m) in enumerate(cases)]
    one = patterns.agg(*sums)
    rows = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).cast("string").alias("without"), F.coalesce(F.col(f"k{i}"), F.lit(0)).alias("n_kept")) for i, (v, r, _) in enumerate(cases)])
    return one.select(F.inline(rows))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of the current policy."""
    book = verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(mask("v1"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept")


SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
word AS (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM base WHERE len(w) > 2),
win AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM word),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_symbols > 6 * n_words OR 10 * n_dup_lines > 6 * n_lines) AS kept
FROM m
"""
