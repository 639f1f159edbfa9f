"""Mixing sources to target weights: Pareto order sampling.

A source's target is its share by weight of the budget (150 % of all words), at most twice its own size; what is over goes to
the other sources by weight. With the rate r = target / size, every document of the source is taken floor(r) times for certain.
The rest of the target is a sample without replacement with unequal chances: a document's inclusion chance p is in proportion to
its words, p = min(1, c * words), with c such that the expected words are the rest. Those with p = 1 are certain and taken first;
the others are ranked by the random odds u / (1 - u) over their inclusion odds p / (1 - p) and taken in that order. The size
of the sample is fixed in words, since the target is in words: it ends where the words are met, and the document on the border is
taken if that comes nearer. u is a hash of doc_id, text and a seed, so reruns agree.

The place where the rank order is cut is found without sorting a source in one task: words are summed in 4096 intervals of
the rank, then in 4096 parts of the interval that holds the cut, and only what is left in the last interval is ordered. Every
document is then compared with its source's cut. Sources and distinct sizes of a source are counted before they meet in a task.
Only DataFrame operations are used.

Defined cases: null or empty text has size 0 and is taken floor(r) times, 0 words; a null source is a source of its own, last in
order; very long texts are ones with large sizes; rows equal in doc_id and text are ranked alike, and if the cut falls among them
as many of them are taken as come nearest to the target, counted over equal whole rows; a null doc_id is ranked by its text; no
rows give no rows; other columns of any name are carried by mix and not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import SPACE, checkpointed, read, stored

WEIGHTS, SEED, FINE = (3, 1, 2), 29, 12
#: Sources up to this many are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def measured(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(f"[^{SPACE}]+"))
    return docs.select("doc_id", "source", words.cast("bigint").alias("size"), F.xxhash64(text).alias("key"), *more)


def targets(rows: DataFrame, weights: tuple = WEIGHTS, budget: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) by water-filling in exact integers. rows: source, size. budget: a fraction of all sizes."""
    num, den = budget
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    big = lambda c: c.cast("decimal(38,0)")
    named = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (((rank - 1) % len(weights)) + 1).cast("int")).cast("bigint"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    run = named.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    run = run.withColumn("before", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # The level per weight if all before are at their bound: top / bottom; the first that stays below its bound sets it.
    run = run.withColumn("top", big(F.col("all")) * num - big(F.col("before")) * (most * den)).withColumn("bottom", F.col("left_w") * den)
    free = big(F.col("w")) * F.col("top") <= big(F.col("source_size")) * (big(F.col("bottom")) * most)
    first = F.min(F.when(free, F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "top", "bottom"))).over(Window.partitionBy())
    run = run.withColumn("free", free).withColumn("level", first)
    share = (F.col("w") * F.col("level.top")).cast("double") / F.col("level.bottom").cast("double")
    return run.select("source", "source_size", F.when(F.col("free"), share).otherwise((F.col("source_size") * most).cast("double")).alias("target"))


def chances(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with the certain copies and, for what is left, `bar`, `c` and `spare`.

    Documents of more than `bar` words are taken once more for certain; others have the chance c * words of a sample of `spare` words.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("certain", F.floor(rate).cast("bigint"))
    goals = goals.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size")))
    some = goals.where("left > 0").select(F.col("source").alias("of"), "source_size", "left")
    each = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    each = each.join(some, F.col("source").eqNullSafe(F.col("of")))
    up = Window.partitionBy("of").orderBy("size")
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    run = each.select("of", "size", "left", "source_size", F.sum(size * n).over(up).alias("words"), F.sum(size * size * n).over(up).alias("squares"))
    above = F.col("source_size") - F.col("words")
    # The chances of all up to this size stay within 1 if it is the largest that is not certain.
    fits = run.where(above + F.col("squares") / F.col("size") >= F.col("left"))
    spare = F.least(F.col("left") - above, F.col("words"))
    last = fits.groupBy("of").agg(F.max_by(F.struct(F.col("size").alias("bar"), spare.alias("spare"), (spare / F.col("squares")).alias("c")), "size").alias("x"))
    joined = goals.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select("source", "source_size", "target", "certain", "x.bar", "x.spare", "x.c")


def _ranked(rows: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """rows with their source's figures; of those that are sampled, the place of the rank in 0 .. 2^53."""
    goals = goals.withColumnRenamed("source", "of")
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    p = F.least(F.col("c") * F.col("size"), F.lit(1 - 1e-12))
    odds = (u / (1 - u)) / (p / (1 - p))
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sampled = (F.col("size") > 0) & (F.col("size") <= F.col("bar")) & (F.col("spare") > 0)
    return joined.withColumn("rank", F.when(sampled, (odds / (1 + odds) * F.lit(float(1 << 53))).cast("bigint")))


def _place():
    """What documents of a source are ordered by; equal only for rows that are equal in doc_id, text and size."""
    return F.struct(F.col("rank").alias("r"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("key").alias("k"), F.col("size").alias("s"))


def cuts(ranked: DataFrame) -> DataFrame:
    """(of, cut, take): the last place of each source's sample, and how many of the rows there are taken."""
    shift = 53 - FINE

    def crossing(frame: DataFrame, by: list[str], cell) -> DataFrame:
        """Of each group, the cell in which the running words reach `spare`, and the words before it."""
        summed = frame.withColumn("cell", cell).groupBy(*by, "cell").agg(F.sum("size").alias("words"), F.first("spare").alias("spare"))
        run = summed.withColumn("upto", F.sum("words").over(Window.partitionBy(*by).orderBy("cell")))
        return run.where((F.col("upto") >= F.col("spare")) & (F.col("upto") - F.col("words") < F.col("spare"))).select(*by, "cell", (F.col("upto") - F.col("words")).alias("before"))

    def held(frame: DataFrame, found: DataFrame, cell) -> DataFrame:
        found = found.select(F.col("source").alias("of"), F.col("cell").alias("in_cell"), F.col("before").alias("b"))
        return frame.join(found, F.col("source").eqNullSafe(F.col("of")) & (cell == F.col("in_cell"))).select("source", "place", "size", "rank", (F.col("spare") - F.col("b")).alias("spare"))

    open_ = ranked.where("rank is not null").select("source", _place().alias("place"), "size", "rank", "spare")
    one = F.shiftright("rank", shift)
    first = held(open_, crossing(open_, ["source"], one), one)
    two = F.shiftright("rank", shift - FINE)
    second = held(first, crossing(first, ["source"], two), two)
    ties = second.groupBy("source", "place").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("spare").alias("spare"))
    order = Window.partitionBy("source").orderBy("place")
    run = ties.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(order)).withColumn("before", F.col("upto") - F.col("size") * F.col("n"))
    at = run.where((F.col("upto") >= F.col("spare")) & (F.col("before") < F.col("spare")))
    return at.select(F.col("source").alias("of"), F.col("place").alias("cut"), F.least(F.col("n"), F.round((F.col("spare") - F.col("before")) / F.col("size")).cast("bigint")).alias("take"))


def mixed(rows: DataFrame, seed: int = SEED, sizes: DataFrame | None = None, **rules) -> DataFrame:
    """rows (doc_id, source, size, key, ...) with source_size, target and copies, how often the mix takes the document.

    sizes: doc_id, source, size and key of the same rows, stored, for the passes that need no more.
    """
    sizes = sizes or rows
    goals = checkpointed(chances(sizes, checkpointed(targets(sizes, **rules))))
    found = checkpointed(cuts(_ranked(sizes, goals, seed)))
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    joined = _ranked(rows, goals, seed).join(found, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("place", _place())
    on_cut = F.coalesce((F.col("place") == F.col("cut")) & F.col("rank").isNotNull(), F.lit(False))
    more = F.when(F.col("size") > F.col("bar"), 1).when(F.col("rank").isNotNull() & (F.col("place") < F.col("cut")), 1).otherwise(0)
    out = [*rows.columns, "source_size", "target"]
    sure = joined.where(~on_cut).select(*out, (F.col("certain") + more).alias("copies"))
    # Rows on the cut are equal in doc_id and text; they are counted by whole rows, which are then taken as often as asked.
    edge = joined.where(on_cut).groupBy("source", F.to_json(F.struct(*rows.columns)).alias("same"))
    edge = edge.agg(F.count("*").alias("n"), F.first(F.struct(*out, "certain", "take")).alias("x"))
    edge = edge.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("same")) - F.col("n"))
    edge = edge.select("x", (F.col("x.take") - F.col("before")).alias("here"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
    edge = edge.select(*(F.col(f"x.`{c}`").alias(c) for c in out), (F.col("x.certain") + F.when(F.col("nth") <= F.col("here"), 1).otherwise(0)).alias("copies"))
    return sure.union(edge)


def mix(docs: DataFrame, seed: int = SEED, **rules) -> DataFrame:
    """`docs` with each document as often as the mix takes it. No text is moved between tasks, but for those on a cut."""
    taken = mixed(measured(docs, F.struct("*").alias("row")), seed, stored(measured(docs), "mix-sizes"), **rules).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its size, its source's size and target, and the words that the mix takes of it."""
    rows = stored(measured(read(spark, sf_dir, "documents")), "mix-sizes")
    return mixed(rows, sizes=rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
