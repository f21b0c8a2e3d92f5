"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask laid over consecutive tokens: positions under a ``0`` are ignored, so that a substituted word
there doesn't hide a copied passage. Seeds of test items and of documents are hashed and joined; around every hit the
item is laid over the document on that diagonal, and the pair counts as a leak if some window of ``window`` aligned
tokens agrees in all but ``spare`` of them.

All of it is DataFrame operations. Items' seeds, rows of four numbers, are broadcast only after a count shows that they
are no more than ``BROADCAST_SEEDS``; beyond it the seeds meet in a shuffled join. Hits are reduced to (document, item,
diagonal) before texts are read again, and a document's hits are dealt to groups of about ``GROUP_HITS``, so that no row
holds all of a document that hits without end; items' own words are joined only to the words found under them.

Masks of a fixed span can't hit every pattern of ``spare`` substitutions in a short item. For each length of the items
at hand where they don't, :func:`covering` adds masks over the whole length that hit all of them.

Edge cases: null texts have no tokens; an item shorter than the window is matched whole, and one with fewer tokens
than the shortest mask only where a document has all of its tokens, even if that is a single one; rows equal in id and
text, of documents or items, are one and give one result; empty tables give no rows; other columns are ignored; a null ``doc_id`` or ``item_id`` is carried as it is.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, table, words

#: Masks over consecutive tokens; a pair with at most two substitutions in 12 or 13 tokens meets one of them.
MASKS = ("1101011", "111000111")
WINDOW, SPARE = 13, 2
#: Seeds that are broadcast at most, some 16 MB.
BROADCAST_SEEDS = 200_000
#: Hits of a document that share a row, on average at most.
GROUP_HITS = 64


def seeds(w: Column, masks: tuple[str, ...] = MASKS, whole: tuple[str, ...] = (), need: Column | None = None) -> Column:
    """array<struct<i, h>> of every mask at every place of the token array ``w``; those of ``whole`` only where ``need``,
    if given, is their length."""

    def laid(m: int | str, mask: str, here: Column) -> Column:
        at = F.when(here & (F.size(w) >= len(mask)), F.sequence(F.lit(0), F.size(w) - len(mask))).otherwise(F.array().cast("array<int>"))
        taken = [k for k, c in enumerate(mask) if c == "1"]
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.xxhash64(F.lit(m), *[F.get(w, i + k) for k in taken]).alias("h")))

    parts = [laid(m, mask, F.lit(True)) for m, mask in enumerate(masks)]
    return F.concat(*parts, *[laid(mask, mask, F.lit(True) if need is None else need == len(mask)) for mask in whole])


def spared(need: int, masks: tuple[str, ...], spare: int) -> int:
    """Substitutions allowed in ``need`` tokens: none in fewer than the shortest mask's."""
    return spare if need >= min(map(len, masks)) else 0


def covering(need: int, masks: tuple[str, ...] = MASKS, spare: int = SPARE) -> tuple[str, ...]:
    """Masks of ``need`` tokens that hit what ``masks`` miss: none if those hit every pattern of up to ``spare``
    substitutions in ``need`` tokens. The tokens are cut into two parts more than there are substitutions, so that two
    parts at least are whole; there is a mask for each choice of two."""
    allowed = spared(need, masks, spare)
    laid = [{i + k for k, c in enumerate(mask) if c == "1"} for mask in masks for i in range(need - len(mask) + 1)]
    if all(any(taken.isdisjoint(lost) for taken in laid) for lost in combinations(range(need), min(allowed, need))):
        return ()
    n = min(allowed + 2, need)
    part = [k * n // need for k in range(need)]
    return tuple("".join("01"[x in whole] for x in part) for whole in combinations(range(n), max(1, n - allowed)))


def tokens(text: Column) -> Column:
    return words(F.lower(F.coalesce(text, F.lit(""))))


def row_key() -> Column:
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))


def leaks(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, spare: int = SPARE) -> DataFrame:
    """(doc_id, row, item_id, first_token, n_equal) of every document and item that share a passage: ``first_token`` is the first token
    of the best window in the document, ``n_equal`` the tokens that agree in it."""
    name = F.concat_ws("/", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    items = items.select("item_id", F.xxhash64(name, F.md5(name)).alias("item"), tokens(F.col("text")).alias("w_item")).dropDuplicates(["item"])
    need = F.least(F.lit(window), F.size("w_item"))
    # One number for each length up to the window.
    lengths = sorted(r[0] for r in items.select(need).distinct().collect() if r[0])
    whole = tuple(mask for n in lengths for mask in covering(n, masks, spare))
    item_seeds = items.select("item", F.size("w_item").alias("n_item"), F.explode(seeds(F.col("w_item"), masks, whole, need)).alias("s"))
    item_seeds = item_seeds.select("s.h", "item", "n_item", F.col("s.i").alias("i_item"))
    if item_seeds.select("h").count() <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    named = docs.select("doc_id", row_key().alias("row"), "text")
    exploded = named.select("row", tokens(F.col("text")).alias("w")).select("row", F.explode(seeds(F.col("w"), masks, whole)).alias("s"))
    hits = exploded.select("row", "s.i", "s.h").join(item_seeds, "h").select("row", "item", "n_item", (F.col("i") - F.col("i_item")).alias("shift"))
    hits = materialise(hits.distinct(), "hits")
    groups = hits.groupBy("row").agg(F.ceil(F.count("*") / GROUP_HITS).alias("groups"))
    dealt = hits.join(groups, "row").withColumn("group", F.pmod(F.xxhash64("item", "shift"), F.col("groups")))
    dealt = dealt.groupBy("row", "group").agg(F.collect_list(F.struct("item", "n_item", "shift")).alias("hits"))
    laid = named.join(dealt, "row").select("doc_id", "row", tokens(F.col("text")).alias("w"), "hits")
    # Only the part of the document under the item goes on, not its whole text for every hit.
    low = lambda h: F.greatest(F.lit(0), h["shift"])
    part = F.transform(
        "hits",
        lambda h: F.struct(
            h["item"].alias("item"),
            h["shift"].alias("shift"),
            low(h).alias("lo"),
            F.slice("w", low(h) + 1, F.greatest(F.lit(0), F.least(F.size("w"), h["shift"] + h["n_item"]) - low(h))).alias("under"),
        ),
    )
    laid = laid.select("doc_id", "row", part.alias("parts")).select("doc_id", "row", F.explode_outer("parts").alias("p")).select("doc_id", "row", "p.*")
    laid = laid.join(items, "item")
    same = F.transform("under", lambda x, j: (x == F.get("w_item", F.col("lo") - F.col("shift") + j)).cast("int"))
    laid = laid.withColumn("same", same).withColumn("need", need).where(F.size("same") >= F.col("need"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("need")),
        lambda s: F.struct(
            F.aggregate(F.slice("same", s + 1, F.col("need")), F.lit(0), lambda a, x: a + x).alias("n_equal"), (-(s + F.col("lo"))).alias("minus_at")
        ),
    )
    allowed = F.when(F.col("need") >= min(map(len, masks)), F.lit(spare)).otherwise(F.lit(0))
    best = laid.select("doc_id", "row", "item_id", "need", F.array_max(sums).alias("b")).where(F.col("b.n_equal") >= F.col("need") - allowed)
    best = best.groupBy("doc_id", "row", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "row", "item_id", (-F.col("b.minus_at")).cast("long").alias("first_token"), F.col("b.n_equal").cast("long").alias("n_equal"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that share no passage with any item."""
    bad = leaks(docs, items).select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", row_key()).join(bad, "_row", "left_anti").drop("_row")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaking documents, with the item and place of each leak."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def _seed_sql(side: str, key: str) -> str:
    parts = []
    for m, mask in enumerate(MASKS):
        text = " || chr(10) || ".join(f"w[i + {k}]" for k, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT {key}, i, {m} AS m, {text} AS h FROM (SELECT {key}, w, unnest(range(1, len(w) - {len(mask) - 2})) AS i FROM {side})")
    return " UNION ALL ".join(parts)


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
sd AS ({_seed_sql("d", "row")}), sb AS ({_seed_sql("b", "item_id")}),
hits AS (SELECT DISTINCT sd.row, sb.item_id, sd.i - sb.i AS shift FROM sd JOIN sb ON sd.h = sb.h AND sd.m = sb.m),
cells AS (SELECT h.row, h.item_id, h.shift, d.doc_id, least({WINDOW}, len(b.w)) AS need, unnest(range(1, len(b.w) + 1)) AS j, b.w AS wb, d.w AS wd
      FROM hits h JOIN d ON d.row = h.row JOIN b ON b.item_id = h.item_id),
inside AS (SELECT row, item_id, shift, doc_id, need, j, CASE WHEN wb[j] = wd[j + shift] THEN 1 ELSE 0 END AS same
      FROM cells WHERE j + shift BETWEEN 1 AND len(wd)),
wins AS (SELECT a.row, a.doc_id, a.item_id, a.shift, a.j, a.need, sum(z.same) AS n_equal, count(*) AS n
      FROM inside a JOIN inside z ON a.row = z.row AND a.item_id = z.item_id AND a.shift = z.shift AND z.j BETWEEN a.j AND a.j + a.need - 1
      GROUP BY ALL),
good AS (SELECT *, j + shift - 1 AS first_token FROM wins WHERE n = need AND n_equal >= need - {SPARE})
SELECT doc_id, item_id, first_token, n_equal FROM (
  SELECT doc_id, item_id, first_token::BIGINT AS first_token, n_equal::BIGINT AS n_equal,
         row_number() OVER (PARTITION BY row, item_id ORDER BY n_equal DESC, first_token) AS r FROM good) WHERE r = 1
"""
