"""Alias groups, country labels and languages: builders and lookups. The tables are inputs, never part of the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Groups that are added to the generated ones. Fixed values.
MANUAL_GROUPS = [
    ["nyc", "new york city", "new york", "the big apple"],
    ["mexico city", "ciudad de méxico", "méxico distrito federal", "ciudad de méjico", "méxico", "valle de méxico", "cdmx"],
]
#: Lookup tables up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


def small(table: DataFrame) -> DataFrame:
    """`table` with a broadcast hint, if its counted rows are within the bound."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def alias_table(groups: DataFrame) -> DataFrame:
    """(label, aliases) from groups (group_no, labels); a label in several groups gets the last one."""
    each = groups.select("group_no", "labels", F.explode("labels").alias("label"))
    return each.groupBy("label").agg(F.max_by("labels", "group_no").alias("aliases"))


def with_aliases(rows: DataFrame, label: str, aliases: DataFrame, out: str = "aliases") -> DataFrame:
    """Adds the alias group of a label, or the label itself, in lower case."""
    low = F.lower(F.col(label))
    table = small(aliases.select(F.col("label").alias("_label"), F.col("aliases").alias("_aliases")))
    return rows.join(table, low == F.col("_label"), "left").withColumn(out, F.coalesce("_aliases", F.array(low))).drop("_label", "_aliases")


def with_country_code(rows: DataFrame, label: str, labels: DataFrame, out: str = "country_code") -> DataFrame:
    """Adds the code of a country label: itself if it is a code, else by (label, code), else ''."""
    low = F.lower(F.col(label))
    codes = small(labels.select(F.col("code").alias("_code")).distinct())
    names = small(labels.groupBy(F.col("label").alias("_name")).agg(F.max("code").alias("_of")))
    joined = rows.join(codes, low == F.col("_code"), "left").join(names, low == F.col("_name"), "left")
    return joined.withColumn(out, F.coalesce("_code", "_of", F.lit(""))).drop("_code", "_name", "_of")


def with_languages(rows: DataFrame, code: str, languages: DataFrame, out: str = "languages") -> DataFrame:
    """Adds the languages of a country code; null for an unknown code."""
    table = small(languages.select(F.col("code").alias("_code"), F.col("languages").alias(out)))
    return rows.join(table, F.col(code) == F.col("_code"), "left").drop("_code")


def countries(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, native, languages) from one JSON object, code -> {name, native, languages}."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string, struct<name: string, native: string, languages: array<string>>>")
    return text.select(F.explode(parsed).alias("code", "c")).select(F.lower("code").alias("code"), "c.*")


def country_labels(data: DataFrame) -> DataFrame:
    """(label, code): names and native names in lower case, and `usa`."""
    names = data.select(F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("native")))).alias("label"), "code")
    return names.union(data.sparkSession.createDataFrame([("usa", "us")], "label string, code string")).where("label is not null")


def country_languages(data: DataFrame) -> DataFrame:
    return data.select("code", F.transform("languages", lambda x: F.lower(x)).alias("languages"))


def ordered_distinct(first: Column, rest: Column) -> Column:
    return F.array_distinct(F.concat(F.array(first), rest))


def city_groups(cities: DataFrame, names: DataFrame, languages: DataFrame) -> DataFrame:
    """(group_no, labels): a city's name and its alternate names in the languages of its country, in order, in lower case.

    cities: id, name, country; names: id, iso, name, pos. Groups of one are dropped; the manual groups come last.
    """
    spoken = with_languages(cities.select("id", "name", F.lower("country").alias("country")), "country", languages)
    alt = names.select(F.col("id").alias("_id"), "iso", F.lower("name").alias("alt"), "pos")
    hits = spoken.join(alt, spoken.id == F.col("_id")).where(F.array_contains("languages", F.col("iso")))
    listed = hits.groupBy("id", "name").agg(F.sort_array(F.collect_list(F.struct("pos", "alt"))).alias("alts"))
    groups = listed.select("id", ordered_distinct(F.lower("name"), F.transform("alts", lambda x: x["alt"])).alias("labels")).where(F.size("labels") > 1)
    numbered = groups.select(F.col("id").cast("bigint").alias("group_no"), "labels")
    manual = cities.sparkSession.createDataFrame([((1 << 62) + i, g) for i, g in enumerate(MANUAL_GROUPS)], "group_no bigint, labels array<string>")
    return numbered.union(manual)
