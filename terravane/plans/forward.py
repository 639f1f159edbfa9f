"""Forward geocoding: many parsed addresses against city and address tables, in one plan.

Queries with neither a road nor a house name go to the cities, if they have a city or a country; others go to the streets,
first of the primary source and, only for what it misses, of the secondary one. Rows are found by hashes of a phrase's first tokens,
never by comparing all queries with all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import address, labels
from ..functions.text import tokens_folded, tokens_standard
from ..operators.postings import phrase_places
from ..operators.search import B, K1
from ..operators.settle import settled
from .parse import spellings

FIELDS = ("postcode", "unit", "number", "region")


@dataclass
class Lookups:
    aliases: DataFrame  # label, aliases
    countries: DataFrame  # label, code
    languages: DataFrame  # code, languages


def route(parsed: DataFrame) -> DataFrame:
    """Adds `route`: city, street or empty."""
    p = lambda f: F.col(f"parsed.{f}")
    no_street = p("road").isNull() & (address.blank(p("house")) == "")
    nothing = p("city").isNull() & (address.blank(p("country")) == "")
    return parsed.withColumn("route", F.when(~no_street, "street").when(nothing, "empty").otherwise("city"))


def with_lookups(parsed: DataFrame, lookups: Lookups) -> DataFrame:
    """Adds country_code ('' if unknown), languages and city_aliases."""
    rows = labels.with_country_code(parsed.withColumn("_country", F.col("parsed.country")), "_country", lookups.countries)
    rows = labels.with_languages(rows, "country_code", lookups.languages)
    each = rows.select("query_id", F.explode("parsed.city").alias("_city"))
    found = labels.with_aliases(each, "_city", lookups.aliases).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("city_aliases"))
    return settled(rows.drop("_country").join(found, "query_id", "left"))  # many plans start here


def phrase_hits(phrases: DataFrame, docs: DataFrame, tokens: str) -> DataFrame:
    """(query_id, _id) where a phrase (query_id, code, words) occurs in a row; a null code is any country."""
    rows = docs.select(F.col("_id").alias("id"), F.col(tokens).alias("w"), "country_code")
    met = phrase_places(rows, phrases.select("query_id", "code", F.col("words").alias("qt")))
    return met.where(F.col("code").isNull() | (F.col("code") == F.col("country_code"))).select("query_id", F.col("id").alias("_id")).distinct()


def city_hits(queries: DataFrame, cities: DataFrame) -> DataFrame:
    """(query_id, rank, city columns): the answers by population, one for a known country, else up to five."""
    docs = cities.withColumn("_tokens", tokens_standard(F.col("city")))
    code = F.when(F.col("country_code") != "", F.col("country_code"))
    q = queries.select("query_id", code.alias("code"), "city_aliases")
    phrases = q.select("query_id", "code", F.explode("city_aliases").alias("alias")).select("query_id", "code", tokens_standard(F.col("alias")).alias("words"))
    named = phrase_hits(phrases, docs, "_tokens")
    # Without a city everything in the country matches, or everything: only the first few of each can be an answer.
    order = [F.col("population").desc(), F.col("_id")]
    bare = q.where("city_aliases is null")
    top_of = cities.withColumn("_n", F.row_number().over(Window.partitionBy("country_code").orderBy(*order))).where("_n = 1").select("_id", F.col("country_code").alias("_cc"))
    in_country = bare.join(top_of, F.col("code") == F.col("_cc")).select("query_id", "_id")
    top_all = F.broadcast(cities.orderBy(*order).limit(5).select("_id"))  # five rows
    anywhere = bare.where("code is null").crossJoin(top_all).select("query_id", "_id")
    met = named.union(in_country).union(anywhere).join(cities, "_id").join(q.select("query_id", "code"), "query_id")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= F.when(F.col("code").isNull(), 5).otherwise(1)).drop("code")


def city_location() -> Column:
    """A hit as a location; what is missing is '' or 0."""
    b = address.blank
    return F.struct(
        F.lit("").alias("street"), F.lit("").alias("number"), F.lit("").alias("unit"), b(F.col("city")).alias("city"), F.lit("").alias("district"), b(F.col("region")).alias("region"), F.lit("").alias("postcode"),
        F.coalesce(F.col("location.lat"), F.lit(0)).cast("float").alias("lat"), F.coalesce(F.col("location.lon"), F.lit(0)).cast("float").alias("long"), b(F.col("country_code")).alias("country_code"), F.lit("Geonames").alias("source"), F.lit("").alias("full_street_address"),
    )


def forward_city(queries: DataFrame, cities: DataFrame) -> DataFrame:
    """(query_id, location, other): the first answer and the rest."""
    hits = city_hits(queries, cities).select("query_id", "rank", city_location().alias("l"))
    by = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "l"))).alias("all"))
    return by.select("query_id", F.col("all")[0]["l"].alias("location"), F.transform(F.slice("all", 2, 4), lambda x: x["l"]).alias("other"))


def street_scores(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, _id, score): relevance of the fields that refine, over candidates; statistics over all of `docs`.

    docs: a token column `_t_<field>` for each of FIELDS. The postcode also looks into the unit.
    """
    p = lambda f: address.blank(F.col(f"parsed.{f}"))
    asked = [("postcode", "postcode"), ("unit", "postcode"), ("unit", "unit"), ("number", "house_number"), ("region", "state")]
    clauses = F.array(*(F.struct(F.lit(i).alias("clause"), F.lit(f).alias("field"), tokens_folded(p(part)).alias("words")) for i, (f, part) in enumerate(asked)))
    wanted = queries.select("query_id", F.inline(clauses)).select("query_id", "clause", "field", F.explode(F.array_distinct("words")).alias("token"))
    long_form = lambda rows, *keep: rows.select(*keep, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_t_{f}").alias("words")) for f in FIELDS)))).where("words is not null")
    each = long_form(docs, "_id")
    size = each.groupBy("field").agg(F.avg(F.size("words")).alias("avgdl"), F.count("*").alias("n"))
    df = each.select("field", F.explode(F.array_distinct("words")).alias("token")).join(wanted.select("field", "token").distinct(), ["field", "token"], "left_semi").groupBy("field", "token").agg(F.count("*").alias("df"))
    met = long_form(hits.join(docs, "_id"), "query_id", "_id").join(wanted, ["query_id", "field"])
    met = met.withColumn("tf", F.size(F.filter("words", lambda w: w == F.col("token")))).where("tf > 0").join(df, ["field", "token"]).join(F.broadcast(size), "field")  # four rows
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.size("words") / F.col("avgdl")))
    return hits.join(met.groupBy("query_id", "_id").agg(F.sum(weight).alias("score")), ["query_id", "_id"], "left").select("query_id", "_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def street_hits(queries: DataFrame, addresses: DataFrame) -> DataFrame:
    """(query_id, score, address columns): the best address of each query, ties by id."""
    docs = addresses.select("*", *(tokens_folded(F.col(c)).alias(f"_t_{c}") for c in ("street", "city", *FIELDS)))
    # A country that is given but unknown is the code '', which no address has.
    code = F.when(address.blank(F.col("parsed.country")) != "", F.col("country_code"))
    q = queries.where("parsed.road is not null").withColumn("code", code)
    roads = q.select("query_id", "code", "languages", F.explode("parsed.road").alias("road")).select("query_id", "code", F.explode(spellings(F.col("road"), F.col("languages"))).alias("road"))
    on_road = phrase_hits(roads.select("query_id", "code", tokens_folded(F.col("road")).alias("words")), docs.withColumnRenamed("_t_street", "_s"), "_s")
    in_city = q.where("city_aliases is not null").select("query_id", "code", F.explode("city_aliases").alias("alias")).select("query_id", "code", tokens_folded(F.col("alias")).alias("words"))
    city = phrase_hits(in_city, docs, "_t_city")
    free = q.where("city_aliases is null").select("query_id")
    hits = settled(on_road.join(city, ["query_id", "_id"], "left_semi").union(on_road.join(free, "query_id", "left_semi")))
    scored = street_scores(hits, q, docs)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_id"))
    best = scored.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    return best.join(addresses, "_id")


def forward_street(queries: DataFrame, sources: list[tuple[str, DataFrame]], languages: DataFrame) -> DataFrame:
    """(query_id, location, other): from the first source that has an answer."""
    left, out = queries, None
    for name, table in sources:
        found = settled(street_hits(left, table)).withColumn("source", F.lit(name)).select("query_id", "_id", *(F.col(c) for c in ("street", "unit", "city", "district", "region", "postcode", "country_code", "location", "source")))
        out = found if out is None else out.unionByName(found)
        left = settled(left.join(found.select("query_id"), "query_id", "left_anti"))
    hit = out.withColumn("country_code", address.blank(F.col("country_code"))).join(queries.select("query_id", "parsed"), "query_id")
    hit = labels.with_languages(hit, "country_code", languages, "_languages")
    b = address.blank
    number, unit = address.result_number(F.col("parsed.house_number")), address.result_unit(F.col("unit"), F.col("parsed.unit"))
    location = F.struct(
        b(F.col("street")).alias("street"), number.alias("number"), unit.alias("unit"), *(b(F.col(c)).alias(c) for c in ("city", "district", "region", "postcode")),
        F.coalesce(F.col("location.lat"), F.lit(0)).cast("float").alias("lat"), F.coalesce(F.col("location.lon"), F.lit(0)).cast("float").alias("long"), F.col("country_code"), "source",
        address.full_street_address(F.col("street"), number, unit, F.col("country_code"), F.col("_languages")).alias("full_street_address"),
    )
    return hit.select("query_id", location.alias("location"), F.slice(F.array(location), 1, 0).alias("other"))


def forward(parsed: DataFrame, cities: DataFrame, sources: list[tuple[str, DataFrame]], lookups: Lookups) -> DataFrame:
    """(query_id, location, other) for every parsed query; location is null and other empty if nothing is found."""
    rows = with_lookups(route(parsed), lookups)
    answers = forward_city(rows.where("route = 'city'"), cities).unionByName(forward_street(rows.where("route = 'street'"), sources, lookups.languages))
    return parsed.select("query_id").join(answers, "query_id", "left").withColumn("other", F.coalesce("other", F.slice(F.array("location"), 1, 0)))
