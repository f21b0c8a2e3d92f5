r"""Quality rules, with the document frequency of lines within a host as the method's own rule.

Each non-blank line is normalised (lower case, runs of blanks as one space) and hashed with its host; the distinct
documents that hold it are counted, exact copies of a text once. A line of more than ``max(least_docs, share * the
host's distinct documents)`` documents is boilerplate and is removed; a document of which less than ``least_left`` of
the words remain is rejected.

Everything is DataFrame operations: in-row counts over the words of a text, one aggregate of line hashes, which are
distinct for each text, and two joins that adaptive execution can split.

Edge cases: a null or blank text has no words and fails the base rules; a null source is a host of its own; repeated
rows each get the same verdict and count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, WORD_BREAK, materialise, table, words

SYMBOLS = "#*$%&|<>"
LEAST_DOCS, SHARE, LEAST_LEFT = 20, 0.05, 0.3


def removed_length(text: str, chars: str) -> Column:
    """Characters of ``text`` that are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def window_hashes(w: Column) -> Column:
    """A hash of each three words in a row."""
    at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))


def ordered_windows(hashes: Column) -> Column:
    """(hash, place) of a text's windows by hash; nothing for a text without a repeated one, as most are."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), F.sort_array(placed)).otherwise(none)


def repeated_words(ordered: Column) -> Column:
    """Number of words in windows that occur twice or more, from :func:`ordered_windows`."""
    again = F.filter(ordered, lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        starts,
        state,
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def judge(
    docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, least_left: float = LEAST_LEFT
) -> DataFrame:
    """One row for each document: its counts, ``base_failed``, ``n_removed_words`` (in boilerplate lines),
    ``n_words_left`` and ``kept``; ``removed_lines`` has the numbers of its boilerplate lines, from 0, and is null for none."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-")).alias("host"))
    named = docs.withColumn("copy", F.md5("text"))
    row = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "host", "copy"))
    split = named.withColumn("row", row).withColumn("w", words(F.col("text")))
    split = split.withColumn("blank_free", F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, BLANKS, " ")) != ""))
    measured = split.select(
        "doc_id",
        "row",
        "blank_free",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        removed_length("text", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("blank_free") - F.size(F.array_distinct("blank_free"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("w")).alias("_hashes"),
    )
    measured = measured.withColumn("_windows", ordered_windows(F.col("_hashes"))).withColumn("n_repeat_words", repeated_words(F.col("_windows")))
    measured = measured.drop("blank_free", "_hashes", "_windows")
    normal = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), WORD_BREAK, " ")))
    line = F.col("line")
    keys = named.select("host", "copy", row.alias("row"), F.posexplode(normal).alias("i", "line")).where(line != "").select(
        "host", "copy", "row", "i", F.xxhash64("host", line).alias("k"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).cast("long").alias("n")
    )
    keys = materialise(keys, "lines")
    copies = named.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    counted = keys.select("host", "k", "copy").distinct().groupBy("host", "k").agg(F.count("*").alias("n"))
    frequent = (
        counted.where(F.col("n") > least_docs)
        .join(copies, "host")
        .where(F.col("n") > F.lit(share) * F.col("n_docs"))
        .select("k")
    )
    found = keys.join(frequent, "k", "left_semi").select("row", "i", "n").distinct()
    found = found.groupBy("row").agg(F.sum("n").alias("_gone"), F.collect_list("i").alias("removed_lines"))
    joined = measured.join(found, "row", "left").withColumn("n_removed_words", F.coalesce("_gone", F.lit(0).cast("long")))
    joined = joined.withColumn("n_words_left", F.col("n_words") - F.col("n_removed_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words_left") >= F.lit(least_left) * F.col("n_words"))).alias("kept"),
        "n_removed_words",
        "n_words_left",
        "row",
        "removed_lines",
    )


def row_key() -> Column:
    """The ``row`` of :func:`judge` over ``doc_id``, ``source`` and ``text``."""
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), host, F.md5(F.coalesce("text", F.lit("")))))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that :func:`judge` keeps, with their columns, ``n_removed_lines``, and ``kept_text``, the text
    without its boilerplate lines; all other lines, blank ones too, stay as they are."""
    # Written first: a filter on the verdict would otherwise be pushed into its parts and repeat their work.
    verdicts = materialise(judge(docs).select("row", "kept", "removed_lines"), "verdicts")
    none = F.array().cast("array<int>")
    good = verdicts.where("kept").select(F.col("row").alias("_row"), F.coalesce("removed_lines", none).alias("_removed")).dropDuplicates(["_row"])
    found = docs.withColumn("_row", row_key()).join(good, "_row")
    found = found.withColumn("n_removed_lines", F.size("_removed"))
    lines = F.when(F.col("n_removed_lines") > 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("_lines", lines)
    left = F.when(F.col("n_removed_lines") > 0, F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_removed")).otherwise(none)
    text = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return found.withColumn("kept_text", F.when(F.col("n_removed_lines") > 0, text).otherwise(F.col("text"))).drop("_row", "_removed", "_lines")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("row", "removed_lines")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '-') AS host, md5(coalesce(text, '')) AS copy,
        row_number() OVER () AS row FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
tri AS (SELECT row, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS t FROM pos),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, t) AS n FROM tri) WHERE n >= 2),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) o(k) GROUP BY row),
ln AS (SELECT row, host, copy, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS k,
        len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT row, host, copy, unnest(lines) AS x FROM w)),
hosts AS (SELECT host, count(DISTINCT copy) AS n_docs FROM d GROUP BY host),
frequent AS (SELECT c.host, c.k FROM (SELECT host, k, count(DISTINCT copy) AS n FROM ln GROUP BY host, k) c JOIN hosts h ON h.host = c.host
        WHERE c.n > {LEAST_DOCS} AND c.n > {SHARE} * h.n_docs),
gone AS (SELECT ln.row, sum(ln.n)::BIGINT AS n FROM ln JOIN frequent f ON f.host = ln.host AND f.k = ln.k GROUP BY ln.row),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
        length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(w.lines) - len(list_distinct(w.lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN rep ON rep.row = w.row LEFT JOIN gone ON gone.row = w.row),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - n_removed_words AS n_words_left FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words_left >= {LEAST_LEFT} * n_words AS kept, n_removed_words, n_words_left
FROM b
"""
