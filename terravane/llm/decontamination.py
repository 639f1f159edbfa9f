"""Benchmark decontamination by n-gram windows.

Words are `[0-9a-z]` or any character beyond ASCII, after A-Z became lower case. A benchmark item's windows are its runs of 10
words; an item with fewer words is one window. Documents are scanned once: every window's hash is looked up in a broadcast
hash table of the distinct benchmark windows, and hits are verified on the words themselves. The table is broadcast only
while its size is within `BROADCAST_WINDOWS`; beyond, places and hashes of windows are dealt out by hash, without their words, and
the words of documents with a hit are fetched to verify it. Only hits and one row a document leave the scan. Only DataFrame
operations are used.

Defined cases: null, empty or wordless texts have no words and no windows; very long texts are scanned whole; an item without words
is ignored; items that repeat hit alike and count by distinct item_id; rows that repeat or tie on a doc_id are returned each, by
their own text; no benchmark leaves all clean; no rows give no rows; columns other than doc_id (item_id) and text are carried by
clean and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import ascii_lower, checkpointed, read

WIDTH, BROADCAST_WINDOWS = 10, 500_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def _split(text) -> Column:
    """As words(), but with the separators at both ends cut first, so that no filter is needed; wordless gives one ''."""
    return F.split(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), rf"^{_BETWEEN}", ""), _BETWEEN)


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, n, gram): the windows of each item; n is the number of words."""
    w = items.select("item_id", words("text").alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(width))
    return w.select("item_id", n.alias("n"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at")).select("item_id", "n", F.slice("w", F.col("at"), F.col("n")).alias("gram")).distinct()


def _met(w: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, n_words, start, n, gram_id) by a broadcast table: a row a hit, and one with null start a document."""
    at = w.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words") - lengths[0] + 1))).alias("start"))
    if len(lengths) > 1:
        at = at.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("len"))
    else:
        at = at.withColumn("len", F.lit(lengths[0]))
    # Place 0 stands for the document itself; windows start at 1.
    fits = (F.col("start") > 0) & (F.col("start") + F.col("len") - 1 <= F.col("n_words"))
    at = at.where(fits | ((F.col("start") == 0) & (F.col("len") == lengths[0])))
    at = at.withColumn("hash", F.when(fits, F.xxhash64(F.slice("w", F.greatest(F.lit(1), F.col("start")), F.col("len")))))
    met = at.join(F.broadcast(grams), (F.col("hash") == F.col("key")) & (F.col("len") == F.col("n")), "left")
    met = met.where((F.col("start") == 0) | F.col("key").isNotNull())
    met = met.where((F.col("start") == 0) | (F.slice("w", F.greatest(F.lit(1), F.col("start")), F.col("len")) == F.col("gram")))
    return met.select("doc_id", "text_key", "n_words", F.when(F.col("start") > 0, F.col("start")).alias("start"), F.when(F.col("start") > 0, F.col("n")).alias("n"), "gram_id")


def _met_dealt(w: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """As _met, by shuffles: windows travel as places and hashes, words only for documents with a hit."""

    def places(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_words") - n + 1))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.xxhash64(F.slice("w", i, n)).alias("hash")))

    at = w.select("doc_id", "text_key", "n_words", F.inline(F.flatten(F.array(*map(places, lengths))))).where(F.col("start") + F.col("len") - 1 <= F.col("n_words"))
    near = at.join(grams, (F.col("hash") == F.col("key")) & (F.col("len") == F.col("n"))).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "start", "n", "gram", "gram_id")
    near = checkpointed(near.distinct())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    held = w.join(near.select("d", "t").distinct(), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    met = held.join(near, same).where(F.slice("w", F.col("start"), F.col("n")) == F.col("gram")).select("doc_id", "text_key", "n_words", "start", "n", "gram_id")
    each = w.select("doc_id", "text_key", "n_words", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("n", "int"), ("gram_id", "bigint"))))
    return met.union(each)


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_words, start, n, gram_id): one row for each window that occurs, and one with null start a document;
    and (item_id, gram_id) of the windows."""
    pairs = checkpointed(item_windows(items, width).withColumn("gram_id", F.xxhash64("gram", F.lit(1))).select("item_id", "n", "gram", "gram_id"))
    grams = pairs.select("n", "gram", "gram_id", F.xxhash64("gram").alias("key")).distinct()
    lengths = sorted(r[0] for r in pairs.select("n").distinct().collect()) or [width]  # at most `width` of them
    w = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), _split("text").alias("w"))
    n_words = F.size("w") - F.when(F.element_at("w", -1) == "", 1).otherwise(0)
    w = w.select("doc_id", "text_key", n_words.alias("n_words"), "w")
    return (_met if grams.count() <= broadcast_windows else _met_dealt)(w, grams, lengths), pairs


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """(doc_id, text_key, rows, n_words, n_hit, items, spans): spans are the runs of hit words, first to last, from 1.

    One row for each distinct doc_id and text; rows says how many it stands for.
    """
    found, pairs = hits(docs, items, width, **limits)
    found = checkpointed(found)
    base = found.where("start is null").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.first("n_words").alias("n_words"))
    met = found.where("start is not null").select("doc_id", "text_key", "start", (F.col("start") + F.col("n") - 1).alias("stop"), "gram_id").distinct()
    key = ["doc_id", "text_key"]
    order = Window.partitionBy(*key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = met.select(*key, "start", "stop").distinct().withColumn("reach", reach)
    run = run.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), 1).otherwise(0)).over(order))
    spans = run.groupBy(*key, "run").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    spans = spans.groupBy(*key).agg(F.sum(F.col("last") - F.col("first") + 1).cast("bigint").alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    which = met.select(*key, "gram_id").distinct().join(pairs.select("gram_id", "item_id"), "gram_id")
    which = which.groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    some = spans.join(which, key).select(*(F.col(c).alias(f"k_{c}") for c in key), "n_hit", "items", "spans")
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("text_key") == F.col("k_text_key"))
    return base.join(some, same, "left").select(*key, "rows", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def clean(docs: DataFrame, items: DataFrame, action: str = "documents", width: int = WIDTH) -> DataFrame:
    """`docs` without the documents that hold a benchmark window or, with action 'spans', without the hit words."""
    if action not in ("documents", "spans"):
        raise ValueError(action)
    bad = contamination(docs, items, width).where("n_hit > 0").select(F.col("doc_id").alias("b_doc"), F.col("text_key").alias("b_key"), "spans")
    here = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("here_key"))
    same = F.col("row.doc_id").eqNullSafe(F.col("b_doc")) & (F.col("here_key") == F.col("b_key"))
    if action == "documents":
        return here.join(bad, same, "left_anti").select("row.*")
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all("row.text", F.lit(piece), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (i + 1 >= s["first"]) & (i + 1 <= s["last"])))
    text = F.concat(F.array_join(kept, ""), F.regexp_extract("row.text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0))
    return here.join(bad, same, "left").select(*(F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(text).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: words, words hit, and the benchmark items that occur in it."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    each = found.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram FROM (
      SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
