"""One query for each operator, over the star-schema tables, with its SQL where SQL can express it.

The tables hold no addresses, so stand-ins are used: a place is a customer (city: market segment and nation; region: nation;
country: region; population: whole balance), streets are documents, zones are a fixed set of polygons over two dimensions of the
embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..folder import new_folder
from ..functions import address, geo, labels, text
from ..operators import keyed, postings, search as s, spatial
from ..schema import ZONE
from ..sources import readers
from ..streaming import ingest
from . import forward as fw, parse

REGISTRY: dict[str, tuple[Callable, str | None]] = {}
#: The tokens of FOLD are applied on both sides; these are its SQL forms.
_SQL_FOLD = "translate({}, '" + text.FOLD_FROM.replace("'", "''") + "', '" + text.FOLD_TO.replace("'", "''") + "')"
for _pair, _letters in text.PAIRS.items():
    _SQL_FOLD = f"replace({_SQL_FOLD}, '{_pair}', '{_letters}')"
_SQL_TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"


def sql_tokens(column: str, fold: bool = False) -> str:
    inner = _SQL_FOLD.replace("{}", column, 1) if fold else column
    return f"regexp_extract_all(lower({inner}), '{_SQL_TOKEN}')"


def query(sql: str | None = None):
    def add(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"[{', '.join(show(x) for x in v)}]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


# ---- filters

@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_term(spark, sf):
    return s.matching(table(spark, sf, "customer"), s.Search().filter_term("c_mktsegment", "BUILDING")).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_terms(spark, sf):
    return s.matching(table(spark, sf, "customer"), s.Search().filter_terms("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
def filter_range(spark, sf):
    return s.matching(table(spark, sf, "orders"), s.Search().filter_range("o_orderpriority", "4", "2")).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE props IS NOT NULL AND value IS NOT NULL")
def filter_exists(spark, sf):
    return s.matching(table(spark, sf, "events"), s.Search().filter_exists("props").filter_exists("value")).select("event_id")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IS DISTINCT FROM 'Brand#1'")
def must_not_term(spark, sf):
    return s.matching(table(spark, sf, "part"), s.Search().must_not_term("p_brand", "Brand#1")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR p_type NOT IN ('ECONOMY', 'PROMO')")
def must_not_terms(spark, sf):
    return s.matching(table(spark, sf, "part"), s.Search().must_not_terms("p_type", ["ECONOMY", "PROMO"])).select("p_partkey", "p_type")


@query("SELECT event_id FROM events WHERE nullif(event_type, 'error') IS NULL")
def must_not_exists(spark, sf):
    rows = table(spark, sf, "events").withColumn("kind", F.nullif("event_type", F.lit("error")))
    return s.matching(rows, s.Search().must_not_exists("kind")).select("event_id")


@query("SELECT p_partkey FROM part WHERE (p_brand = 'Brand#3')::INT + (p_type = 'PROMO')::INT + (p_size >= 25)::INT >= 2")
def min_should_match(spark, sf):
    body = s.Search().should_term("p_brand", "Brand#3").should_term("p_type", "PROMO").should_range("p_size", "", 25).minimum_should_match(2)
    return s.matching(table(spark, sf, "part"), body).select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND (l_quantity < 5 OR (l_discount >= 0.05 AND l_discount < 0.07)) AND NOT l_linestatus = 'O'""")
def filter_custom_nested_bool(spark, sf):
    inner = s.Search().should_range("l_quantity", 5, "").should_custom(s.Search().filter_range("l_discount", 0.07, 0.05)).minimum_should_match(1)
    body = s.Search().filter_term("l_returnflag", "R").filter_custom(inner).must_not_term("l_linestatus", "O")
    return s.matching(table(spark, sf, "lineitem"), body).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey FROM part WHERE p_size % 7 = 3 AND p_retailprice > 910")
def filter_raw(spark, sf):
    return s.matching(table(spark, sf, "part"), s.Search().filter_raw("p_size % 7 = 3").filter_raw(F.col("p_retailprice") > 910)).select("p_partkey")


# ---- text

@query(f"SELECT doc_id FROM documents WHERE list_has_any({sql_tokens('text')}, ['ered', 'oned', 'schverein'])")
def match_any(spark, sf):
    return s.matching(table(spark, sf, "documents"), s.Search().filter_match("text", "Ered oned SCHVEREIN")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({sql_tokens('text')}, ' ') || ' ', ' of the ')")
def match_phrase(spark, sf):
    return s.matching(table(spark, sf, "documents"), s.Search().filter_match_phrase("text", "of the")).select("doc_id")


_SQL_ANALYZED = "SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {} AS w FROM documents)"


@query(_SQL_ANALYZED.replace("{}", sql_tokens("text", True)))
def analyze_folded(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.tokens_folded(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("words_md5"))


@query(_SQL_ANALYZED.replace("{}", sql_tokens("text")))
def analyze_standard(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.tokens_standard(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("words_md5"))


@query(f"""SELECT doc_id FROM documents WHERE lang = 'en' AND list_has_any({sql_tokens('text')}, ['ered', 'oned'])::INT
+ contains(' ' || array_to_string({sql_tokens('text')}, ' ') || ' ', ' of the ')::INT + (n_chars % 2 = 0)::INT >= 2""")
def should_match_phrase_raw(spark, sf):
    body = s.Search().filter_term("lang", "en").should_match("text", "Ered oned").should_match_phrase("text", "of the").should_raw("n_chars % 2 = 0").minimum_should_match(2)
    return s.matching(table(spark, sf, "documents"), body).select("doc_id")


_SQL_RUNS = "{0} AS (SELECT DISTINCT {1}, n, list_slice(w, i, i + n - 1) AS gram FROM (SELECT {1}, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {2}))"


@query(f"""WITH b AS (SELECT item_id, w, least(len(w), 8) AS n FROM (SELECT item_id, {sql_tokens('text')} AS w FROM benchmark) WHERE len(w) > 0),
{_SQL_RUNS.format('q', 'item_id', 'b')}, d AS (SELECT doc_id, w, n FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents), (SELECT DISTINCT n FROM b) WHERE len(w) >= n),
{_SQL_RUNS.format('p', 'doc_id', 'd')} SELECT item_id, doc_id, count(*)::BIGINT AS runs FROM q JOIN p USING (n, gram) GROUP BY ALL""")
def phrase_join_benchmark(spark, sf):
    """Every run of eight words of every item, as a phrase."""
    docs = table(spark, sf, "documents").select("doc_id", text.tokens_standard(F.col("text")).alias("words"))
    items = table(spark, sf, "benchmark").select("item_id", text.tokens_standard(F.col("text")).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 7)), lambda i: F.slice("w", i, 8))
    phrases = items.select("item_id", F.explode(F.array_distinct(runs)).alias("q")).select(F.struct("item_id", "q").alias("phrase"), "q")
    met = postings.phrase_join(docs, "doc_id", "words", phrases, "phrase", "q")
    return met.groupBy(F.col("phrase.item_id").alias("item_id"), "doc_id").agg(F.count("*").alias("runs"))


@query(f"""WITH d AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
q AS (SELECT item_id, tok, count(*) AS times FROM (SELECT item_id, unnest({sql_tokens('text')}) AS tok FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, tok, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, unnest(w) AS tok, len(w) AS dl FROM d) GROUP BY doc_id, tok),
f AS (SELECT tok, count(*) AS df FROM p GROUP BY tok),
x AS (SELECT item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM q JOIN p USING (tok) JOIN f USING (tok), st GROUP BY item_id, doc_id)
SELECT item_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM x) WHERE rank <= 3""")
def bm25_topk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.tokens_standard(F.col("text")).alias("words"))
    asked = table(spark, sf, "benchmark").select("item_id", text.tokens_standard(F.col("text")).alias("q"))
    scored = postings.bm25(docs, "doc_id", "words", asked, "item_id", "q")
    return postings.best(scored, "item_id", "doc_id", 3).select("item_id", F.round("score", 4).alias("score"), "rank")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^s.*l r.ng$')")
def wildcard(spark, sf):
    return s.matching(table(spark, sf, "part"), s.Search().wild_card("p_name", "S*l r?ng")).select("p_partkey", "p_name")


# ---- nested fields, children

def _orders(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("lines"))
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


@query("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45")
def nested_exists(spark, sf):
    return s.matching(_orders(spark, sf), s.Search().filter_nested("lines", s.Search().filter_term("lines.l_returnflag", "R").filter_range("lines.l_quantity", "", 45))).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
HAVING bool_or(l_returnflag = 'R')::INT + bool_or(l_quantity >= 49)::INT + bool_or(l_tax >= 0.08)::INT >= 2""")
def should_nested(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag", "l_tax")).alias("lines"))
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    body = s.Search().minimum_should_match(2).should_nested("lines", s.Search().filter_term("lines.l_returnflag", "R"))
    body = body.should_nested("lines", s.Search().filter_range("lines.l_quantity", "", 49)).should_nested("lines", s.Search().filter_range("lines.l_tax", "", 0.08))
    return s.matching(rows, body).select("o_orderkey")


@query("""SELECT o_orderkey, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag = 'R' AND l_quantity >= 49 GROUP BY o_orderkey""")
def nested_inner_hits(spark, sf):
    body = s.Search().filter_nested("lines", s.Search().filter_term("l_returnflag", "R").filter_range("l_quantity", "", 49), ["l_linenumber", "l_quantity"])
    hits = s.search(_orders(spark, sf), body, "o_orderkey", size=None, sort=["o_orderkey:asc"]).rows
    return hits.select("o_orderkey", F.size("lines_inner_hits").cast("bigint").alias("n"), F.aggregate("lines_inner_hits", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax >= 0.08)")
def has_child_semi(spark, sf):
    body = s.Search().has_child(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", s.Search().filter_range("l_tax", "", 0.08))
    return s.matching(table(spark, sf, "orders"), body).select("o_orderkey")


@query("SELECT o_orderkey, count(*)::DOUBLE AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 40 GROUP BY o_orderkey")
def has_child_sum(spark, sf):
    body = s.Search().has_child(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", s.Search().must_range("l_quantity", "", 40), "sum")
    return s.search(table(spark, sf, "orders"), body, "o_orderkey", size=None).rows.select("o_orderkey", F.col("_score").alias("score"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 7")
def parent_id(spark, sf):
    return s.matching(table(spark, sf, "lineitem"), s.Search().with_parent_id("l_orderkey", 7)).select("l_orderkey", "l_linenumber")


# ---- scores, order, paging

_IDF = "ln(1 + (n - {0} + 0.5) / ({0} + 0.5)) / 2.2"


@query(f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_type = 'PROMO') AS a, count(*) FILTER (WHERE p_brand = 'Brand#3') AS b FROM part)
SELECT p_partkey, round({_IDF.format('a')} + CASE WHEN p_brand = 'Brand#3' THEN {_IDF.format('b')} ELSE 0 END + CASE WHEN p_size >= 40 THEN 1 ELSE 0 END, 6) AS score
FROM part, c WHERE p_type = 'PROMO'""")
def should_score(spark, sf):
    body = s.Search().must_term("p_type", "PROMO").should_term("p_brand", "Brand#3").should_range("p_size", "", 40)
    return s.search(table(spark, sf, "part"), body, "p_partkey", size=None).rows.select("p_partkey", F.round("_score", 6).alias("score"))


@query(f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_type = 'PROMO') AS a FROM part)
SELECT p_partkey FROM part, c WHERE {_IDF.format('a')} * (p_type = 'PROMO')::INT + (p_size >= 40)::INT + (p_size IS NOT NULL)::INT >= 2""")
def min_score(spark, sf):
    body = s.Search().should_term("p_type", "PROMO").should_range("p_size", "", 40).should_exists("p_size").min_score(2.0)
    return s.search(table(spark, sf, "part"), body, "p_partkey", size=None).rows.select("p_partkey")


@query("SELECT p_partkey, round((1 + 1) * p_retailprice / 100, 6) AS score FROM part WHERE p_size IN (1, 2, 3)")
def function_score_script(spark, sf):
    body = s.Search().must_terms("p_size", [1, 2, 3]).match_all().function_score_script("p_retailprice / 100")
    return s.search(table(spark, sf, "part"), body, "p_partkey", size=None).rows.select("p_partkey", F.round("_score", 6).alias("score"))


@query()
def function_score_random(spark, sf):
    return s.search(table(spark, sf, "part"), s.Search().match_all().function_score_random(7), "p_partkey", size=20).rows.select("p_partkey", "_score")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_topk(spark, sf):
    return s.search(table(spark, sf, "orders"), s.Search(), "o_orderkey", size=25, sort=["o_totalprice:desc"]).rows.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def search_one(spark, sf):
    return s.search_one(table(spark, sf, "orders"), s.Search().filter_term("o_orderstatus", "F").sort("o_totalprice", "desc"), "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 15 OFFSET 30")
def from_size(spark, sf):
    return s.search(table(spark, sf, "orders"), s.Search(), "o_orderkey", size=15, start=30, sort=["o_orderdate:asc"]).rows.select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 400000 OR (o_totalprice = 400000 AND o_orderkey > 10)
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def search_after(spark, sf):
    return s.search(table(spark, sf, "orders"), s.Search().sort("o_totalprice", "desc").search_after(400000.0, 10), "o_orderkey").rows.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 50")
def source_includes(spark, sf):
    body = s.Search().filter_term("o_orderpriority", "1-URGENT")
    return s.search(table(spark, sf, "orders"), body, "o_orderkey", size=50, sort=["o_orderkey:asc"], includes=["o_orderkey", "o_orderstatus"]).rows


@query("SELECT count(*)::BIGINT AS total FROM orders WHERE o_orderpriority = '1-URGENT'")
def total_hits(spark, sf):
    return s.matching(table(spark, sf, "orders"), s.Search().filter_term("o_orderpriority", "1-URGENT")).agg(F.count("*").alias("total"))


@query("""SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS members
FROM orders GROUP BY o_custkey""")
def collapse(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    groups = s.collapse(rows, "o_custkey", s.ordering([("o_totalprice", "desc"), ("o_orderkey", "asc")]), ["o_orderkey"])
    return groups.select("o_custkey", F.col("o_orderkey").alias("best"), F.array_join(F.transform("inner_hits", lambda x: x["o_orderkey"].cast("string")), ",").alias("members"))


_STATS = "SELECT '{0}' AS field, count({0})::BIGINT AS count, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max, round(avg({0}), 4) AS avg, round(sum({0}), 2)::DOUBLE AS sum FROM {1}"


@query(" UNION ALL ".join(_STATS.format(f, "lineitem WHERE l_returnflag = 'R'") for f in ("l_quantity", "l_discount")))
def stats_agg(spark, sf):
    return _rounded(s.statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], s.Search().filter_term("l_returnflag", "R")))


@query(_STATS.format("k", "(SELECT json_extract_string(props, '$.k')::BIGINT AS k FROM events)"))
def stats_agg_nested(spark, sf):
    rows = table(spark, sf, "events").select(F.array(F.from_json("props", "k bigint")).alias("items"))
    return _rounded(s.statistics(rows, ["k"], nested_path="items"))


def _rounded(rows):
    return rows.withColumns({"avg": F.round("avg", 4), "sum": F.round("sum", 2)})


# ---- keyed tables

@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def upsert_last_write_wins(spark, sf):
    return keyed.last_writes(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(ts AS DATE) <= DATE '2024-01-15' AS early FROM events),
b AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM e WHERE early GROUP BY user_id),
n AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM e WHERE NOT early AND event_type <> 'view' GROUP BY user_id)
SELECT user_id, coalesce(n.event_id, b.event_id) AS event_id, coalesce(n.event_type, b.event_type) AS event_type FROM b FULL JOIN n USING (user_id)""")
def upsert_merge_batches(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.to_date("ts") <= F.lit("2024-01-15").cast("date")).alias("early"))
    base = keyed.last_writes(rows.where("early").drop("early"), "user_id", "event_id")
    new = keyed.last_writes(rows.where("not early and event_type <> 'view'").drop("early"), "user_id", "event_id")
    return keyed.merged(base, new, "user_id")


@query("SELECT vec_id::VARCHAR AS id, round(embedding[1]::DOUBLE * 600, 4) AS lat FROM embeddings WHERE embedding[1]::DOUBLE * 600 BETWEEN -90 AND 90 AND embedding[2]::DOUBLE * 900 BETWEEN -180 AND 180")
def geo_range_validate(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), (F.col("embedding")[0].cast("double") * 600).alias("lat"), (F.col("embedding")[1].cast("double") * 900).alias("long"))
    return rows.where(keyed.in_range(F.col("lat"), F.col("long"))).select("id", F.round("lat", 4).alias("lat"))


@query("SELECT n_nationkey, nullif(CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, '') AS region, (n_nationkey % 3 <> 0)::INT AS has_region FROM nation")
def omitempty_json(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("_id"), F.nullif(F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")), F.lit("")).alias("region"))
    docs = keyed.as_json(rows)
    return docs.select(F.col("_id").alias("n_nationkey"), F.get_json_object("doc", "$.region").alias("region"), F.contains("doc", F.lit("region")).cast("int").alias("has_region"))


@query("SELECT s_suppkey, s_suppkey::VARCHAR || s_name || s_nationkey::VARCHAR AS id FROM supplier")
def concat_id(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", address.concat_id(F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string")).alias("id"))


@query("SELECT s_suppkey, md5(s_name || chr(31) || s_nationkey::VARCHAR) AS id FROM supplier")
def hash_id(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", address.hash_id(F.col("s_name"), F.col("s_nationkey")).alias("id"))


# ---- sources

@query("SELECT page_id, string_split(regexp_replace(url, '^https?://[^/]+/', ''), '/')[1] AS country FROM pages")
def country_from_path(spark, sf):
    rows = table(spark, sf, "pages").withColumn("path", F.regexp_replace("url", "^https?://[^/]+/", ""))
    return rows.select("page_id", readers.country_of_path(F.col("path")).alias("country"))


_PATHS = "url || CASE page_id % 4 WHEN 0 THEN '-addresses-city.geojson' WHEN 1 THEN '-buildings-city.geojson' WHEN 2 THEN '-parcels-county.geojson' ELSE '.json' END"


@query(f"SELECT page_id FROM (SELECT page_id, {_PATHS} AS path FROM pages) WHERE path LIKE '%.geojson' AND NOT ({' OR '.join(f'contains(path, {chr(39)}{p}{chr(39)})' for p in readers.EXCLUDED)})")
def exclude_patterns(spark, sf):
    rows = table(spark, sf, "pages").withColumn("path", F.expr(_PATHS))
    return rows.where(readers.is_address_file(F.col("path"))).select("page_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(try_cast(json_extract_string(props, '$.x') AS BIGINT), 0) AS x FROM events")
def json_props_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.expr("try_cast(get_json_object(props, '$.x') as bigint)"), F.lit(0)).alias("x"))


_NODES = "SELECT l_partkey AS id, (l_partkey % 90)::DOUBLE AS lat, (l_partkey % 180)::DOUBLE AS lon FROM (SELECT DISTINCT l_partkey FROM lineitem)"


@query(f"""WITH n AS ({_NODES}) SELECT l_orderkey AS id, string_agg(n.id::VARCHAR || ':' || lat::BIGINT::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS points
FROM lineitem JOIN n ON l_partkey = n.id GROUP BY l_orderkey""")
def way_node_join(spark, sf):
    lines = table(spark, sf, "lineitem")
    ways = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("n")).select("id", F.transform("n", lambda x: x["l_partkey"]).alias("nodes"))
    nodes = lines.select(F.col("l_partkey").alias("id")).distinct().select("id", (F.col("id") % 90).cast("double").alias("lat"), F.col("id").cast("double").alias("long"))
    points = F.transform("points", lambda p: F.concat(p["long"].cast("bigint").cast("string"), F.lit(":"), p["lat"].cast("bigint").cast("string")))
    return spatial.way_points(ways, nodes).select("id", F.array_join(points, ",").alias("points"))


# ---- lookups

_GROUPS = [(0, ["africa", "afrika"]), (1, ["nation_1", "first nation", "one"]), (2, ["nation_2", "second nation"]), (3, ["one", "nation_1", "uno"])]
_LABELS = [("africa", "za"), ("america", "us"), ("asia", "cn"), ("europe", "de"), ("usa", "us")]
_LANGUAGES = [("za", ["en", "af"]), ("us", ["en"]), ("cn", ["zh"]), ("de", ["de"]), ("be", ["nl", "fr", "de"]), ("fr", ["fr"])]


def _lookups(spark):
    groups = literal(spark, _GROUPS, "group_no int, labels array<string>")
    return fw.Lookups(labels.alias_table(groups), literal(spark, _LABELS, "label string, code string"), literal(spark, _LANGUAGES, "code string, languages array<string>"))


_SQL_ALIASES = f"g(no, labels) AS (VALUES {values(_GROUPS)}), a AS (SELECT label, arg_max(labels, no) AS aliases FROM (SELECT no, labels, unnest(labels) AS label FROM g) GROUP BY label)"


@query(f"WITH {_SQL_ALIASES} SELECT n_nationkey, array_to_string(coalesce(aliases, [lower(n_name)]), ',') AS aliases FROM nation LEFT JOIN a ON lower(n_name) = label")
def alias_expand(spark, sf):
    rows = labels.with_aliases(table(spark, sf, "nation"), "n_name", _lookups(spark).aliases)
    return rows.select("n_nationkey", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {_SQL_ALIASES} SELECT label, array_to_string(aliases, ',') AS aliases FROM a")
def alias_last_group_wins(spark, sf):
    return _lookups(spark).aliases.select("label", F.array_join("aliases", ",").alias("aliases"))


@query(f"""WITH l(label, code) AS (VALUES {values(_LABELS)}) SELECT r_regionkey, coalesce((SELECT max(code) FROM l WHERE code = lower(r_name)), (SELECT max(code) FROM l WHERE label = lower(r_name)), '') AS country_code FROM region""")
def country_label_to_code(spark, sf):
    return labels.with_country_code(table(spark, sf, "region"), "r_name", _lookups(spark).countries).select("r_regionkey", "country_code")


@query(f"""WITH l(label, code) AS (VALUES {values(_LABELS)}), g(code, languages) AS (VALUES {values(_LANGUAGES)})
SELECT r_regionkey, array_to_string(languages, ',') AS languages FROM region LEFT JOIN l ON label = lower(r_name) LEFT JOIN g ON l.code = g.code""")
def country_languages(spark, sf):
    look = _lookups(spark)
    rows = labels.with_languages(labels.with_country_code(table(spark, sf, "region"), "r_name", look.countries), "country_code", look.languages)
    return rows.select("r_regionkey", F.array_join("languages", ",").alias("languages"))


@query("""WITH x AS (SELECT n_nationkey, lower(n_name) AS main, lower(c_name) AS alt, min(c_custkey) AS pos FROM nation JOIN customer ON c_nationkey = n_nationkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND lower(c_name) <> lower(n_name) GROUP BY ALL)
SELECT n_nationkey::BIGINT AS group_no, main || ',' || string_agg(alt, ',' ORDER BY pos) AS labels FROM x GROUP BY n_nationkey, main""")
def label_group_generate(spark, sf):
    cities = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("XX").alias("country"))
    names = table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("iso"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    spoken = literal(spark, [("xx", ["BUILDING", "MACHINERY"])], "code string, languages array<string>")
    return labels.city_groups(cities, names, spoken).where(f"group_no < {1 << 62}").select("group_no", F.array_join("labels", ",").alias("labels"))


_COUNTRIES = [("dk", "Denmark", "Danmark", ["da"]), ("fr", "France", "France", ["fr"]), ("aq", "Antarctica", "Antarctica", [""])]


@query(f"WITH c(code, name, native, languages) AS (VALUES {values(_COUNTRIES)}) SELECT lower(name) AS label, code FROM c UNION SELECT lower(native), code FROM c UNION SELECT 'usa', 'us'")
def country_labels_generate(spark, sf):
    return labels.country_labels(literal(spark, _COUNTRIES, "code string, name string, native string, languages array<string>"))


@query(f"WITH c(code, name, native, languages) AS (VALUES {values(_COUNTRIES)}) SELECT code, lower(array_to_string(languages, ',')) AS languages FROM c")
def country_languages_generate(spark, sf):
    rows = labels.country_languages(literal(spark, _COUNTRIES, "code string, name string, native string, languages array<string>"))
    return rows.select("code", F.array_join("languages", ",").alias("languages"))


# ---- space

_RINGS = {  # name: (polygons, cx, cy); two squares that overlap, one with a hole, one of two parts
    "west": ([[[(-30, -30), (2, -30), (2, 30), (-30, 30)]]], -14.0, 0.0),
    "east": ([[[(-2, -20), (30, -20), (30, 20), (-2, 20)]]], 14.0, 0.0),
    "ring": ([[[(-10, -40), (10, -40), (10, -22), (-10, -22)], [(-4, -36), (4, -36), (4, -26), (-4, -26)]]], 0.0, -31.0),
    "isles": ([[[(20, 22), (28, 22), (24, 34)]], [[(-28, 32), (-20, 32), (-24, 44)]]], 0.0, 31.0),
}


def _zones(spark):
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    rows = [(n, n, "xx", [[[point(p) for p in ring] for ring in poly] for poly in polys], cx, cy, i) for i, (n, (polys, cx, cy)) in enumerate(_RINGS.items())]
    return spark.createDataFrame(rows, ZONE)


_EDGES = [(z, i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for z, (polys, _, _) in _RINGS.items() for i, poly in enumerate(polys) for ring in poly for a, b in zip(ring, ring[1:] + ring[:1])]
_ABOUT = [(z, cx, cy, i) for i, (z, (_, cx, cy)) in enumerate(_RINGS.items())]
_SQL_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_SQL_POINTS = "p AS (SELECT vec_id, embedding[1]::DOUBLE * 160 AS x, embedding[2]::DOUBLE * 160 AS y FROM embeddings)"
_SQL_INSIDE = f"""{_SQL_POINTS}, e(zone, poly, x1, y1, x2, y2) AS (VALUES {values(_EDGES)}), z(zone, cx, cy, load_order) AS (VALUES {values(_ABOUT)}),
c AS (SELECT vec_id, x, y, zone, poly FROM p, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
w AS (SELECT vec_id, arg_min(zone, floor({_SQL_HAVERSINE.format('y', 'x', 'cy', 'cx')}) * 10 + load_order) AS zone FROM c JOIN z USING (zone) GROUP BY vec_id)"""


def _points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 160).alias("x"), (F.col("embedding")[1].cast("double") * 160).alias("y"))


@query(f"WITH {_SQL_INSIDE} SELECT p.vec_id, coalesce(w.zone, '') AS zone FROM p LEFT JOIN w USING (vec_id)")
def zone_detect(spark, sf):
    return spatial.zone_names(_points(spark, sf), _zones(spark), "vec_id", "x", "y", 4.0, out="zone").select("vec_id", "zone")


_SEGMENT = "greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"


@query(f"""WITH {_SQL_INSIDE},
l AS (SELECT vec_id, x, y, e.zone, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM (SELECT *, {_SEGMENT} AS t FROM p ANTI JOIN w USING (vec_id), e) e),
n AS (SELECT vec_id, x, y, zone, arg_min(px, (px - x) * (px - x) + (py - y) * (py - y)) AS px, arg_min(py, (px - x) * (px - x) + (py - y) * (py - y)) AS py FROM l GROUP BY ALL),
f AS (SELECT vec_id, arg_min(zone, floor({_SQL_HAVERSINE.format('y', 'x', 'cy', 'cx')}) * 10 + load_order) AS zone FROM n JOIN z USING (zone) WHERE {_SQL_HAVERSINE.format('y', 'x', 'py', 'px')} < 200000 GROUP BY vec_id)
SELECT p.vec_id, coalesce(w.zone, f.zone, '') AS country FROM p LEFT JOIN w USING (vec_id) LEFT JOIN f USING (vec_id)""")
def country_detect_fallback(spark, sf):
    codes = _zones(spark).withColumn("country_code", F.col("id"))
    return spatial.country_codes(_points(spark, sf), codes, "vec_id", "x", "y", 4.0, near=200_000.0).select("vec_id", "country")


@query(f"SELECT vec_id, round({_SQL_HAVERSINE.format('embedding[1]::DOUBLE * 100', 'embedding[2]::DOUBLE * 200', '55.5', '12.5')}, 2) AS metres FROM embeddings")
def haversine(spark, sf):
    d = geo.haversine(F.col("embedding")[0].cast("double") * 100, F.col("embedding")[1].cast("double") * 200, F.lit(55.5), F.lit(12.5))
    return table(spark, sf, "embeddings").select("vec_id", F.round(d, 2).alias("metres"))


@query()
def vincenty(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("lat"), (F.col("embedding")[1].cast("double") * 200).alias("lon"))
    return rows.select("vec_id", geo.vincenty("lat", "lon", F.lit(55.5), F.lit(12.5)).alias("metres"))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS cx, round(avg(embedding[2]::DOUBLE), 6) AS cy FROM embeddings GROUP BY label")
def centroid_multipoint(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return spatial.multipoint_centroid(rows, "label", "x", "y").select("label", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("SELECT * FROM (VALUES ('west', -14.0::DOUBLE, 0.0::DOUBLE), ('east', 14.0, 0.0), ('ring', 0.0, -31.0), ('isles', 0.0, 31.0)) t(id, cx, cy)")
def centroid_polygon(spark, sf):
    c = _zones(spark).select("id", geo.centroid(F.col("polygons")).alias("c"))
    return c.select("id", (F.round("c.x", 6) + 0.0).alias("cx"), (F.round("c.y", 6) + 0.0).alias("cy"))


# ---- forward search

_SQL_PLACES = "pl AS (SELECT c_custkey AS _id, c_mktsegment || ' ' || n_name AS city, n_name AS region, lower(r_name) AS country_code, floor(abs(c_acctbal))::INT AS population FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def places(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    point = F.struct((F.col("c_nationkey") * 2).cast("float").alias("lat"), (F.col("c_nationkey") * 3).cast("float").alias("lon"))
    return rows.select(F.col("c_custkey").alias("_id"), F.concat_ws(" ", "c_mktsegment", "n_name").alias("city"), F.col("n_name").alias("region"), F.lower("r_name").alias("country_code"), F.floor(F.abs("c_acctbal")).cast("int").alias("population"), point.alias("location"))


_CITY_LABELS = [("africa", "africa"), ("america", "america"), ("asia", "asia"), ("europe", "europe"), ("states", "america")]
_CITY_ALIASES = [(0, ["building nation_1", "tower"]), (1, ["nation_7", "seven"])]
_ASKED = [(1, "Building NATION_1", "America"), (2, "seven", "asia"), (3, "machinery", "EUROPE"), (4, None, "states"), (5, "nowhere", "asia"), (6, "tower", "states")]
_ASKED_OPEN = [(1, "Household", None), (2, "seven", "Atlantis"), (3, None, "Atlantis"), (4, "nowhere", None)]


def _asked(spark, rows):
    fields = [f.name for f in parse.PARSED.fields]
    full = [(i, {n: None for n in fields} | {"road": None, "city": [c] if c else None, "country": k or "", "house": ""}) for i, c, k in rows]
    from pyspark.sql.types import LongType, StructField, StructType

    return spark.createDataFrame(full, StructType([StructField("query_id", LongType()), StructField("parsed", parse.PARSED)]))


def _city_answers(spark, sf, rows):
    groups = literal(spark, _CITY_ALIASES, "group_no int, labels array<string>")
    look = fw.Lookups(labels.alias_table(groups), literal(spark, _CITY_LABELS, "label string, code string"), literal(spark, _LANGUAGES, "code string, languages array<string>"))
    routed = fw.route(_asked(spark, rows)).where("route = 'city'")
    return fw.city_hits(fw.with_lookups(routed, look), places(spark, sf)).select("query_id", "rank", "_id", "population", "region")


def _sql_city(rows):
    return f"""WITH {_SQL_PLACES}, q(query_id, city, country) AS (VALUES {values(rows)}), l(label, code) AS (VALUES {values(_CITY_LABELS)}),
g(no, labels) AS (VALUES {values(_CITY_ALIASES)}), a AS (SELECT label, arg_max(labels, no) AS aliases FROM (SELECT no, labels, unnest(labels) AS label FROM g) GROUP BY label),
x AS (SELECT query_id, q.city, (SELECT max(code) FROM l WHERE label = lower(country) OR code = lower(country)) AS code, CASE WHEN q.city IS NULL THEN NULL ELSE coalesce(aliases, [lower(q.city)]) END AS al FROM q LEFT JOIN a ON lower(q.city) = label),
o AS (SELECT query_id, code, unnest(coalesce(al, [''])) AS alias, al IS NULL AS bare FROM x),
m AS (SELECT DISTINCT query_id, code, _id, population, region FROM o JOIN pl ON (code IS NULL OR code = country_code) AND (bare OR contains(' ' || array_to_string({sql_tokens('pl.city')}, ' ') || ' ', ' ' || array_to_string({sql_tokens('alias')}, ' ') || ' ')))
SELECT query_id::BIGINT AS query_id, rank, _id, population, region FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY population DESC, _id)::INT AS rank FROM m) WHERE rank <= CASE WHEN code IS NULL THEN 5 ELSE 1 END"""


@query(_sql_city(_ASKED))
def forward_city(spark, sf):
    return _city_answers(spark, sf, _ASKED)


@query(_sql_city(_ASKED_OPEN))
def forward_city_unknown_country(spark, sf):
    return _city_answers(spark, sf, _ASKED_OPEN)


def _streets(spark, sf, lang):
    """Documents of a language as addresses: the whole text is the street."""
    words = text.tokens_standard(F.col("text"))
    rows = table(spark, sf, "documents").where(F.col("lang") == lang)
    null = F.lit(None).cast("string")
    return rows.select(F.col("doc_id").alias("_id"), F.array_join(words, " ").alias("street"), F.col("source").alias("city"), F.lit("xx").alias("country_code"), (F.col("doc_id") % 100).cast("string").alias("number"), null.alias("unit"), null.alias("district"), F.col("source").alias("region"), (F.col("doc_id") % 50).cast("string").alias("postcode"), F.struct(F.lit(1.5).cast("float").alias("lat"), F.lit(2.5).cast("float").alias("lon")).alias("location"))


_ROADS = [(1, "of the", "src1", "12", "7"), (2, "the", None, "9", "3"), (3, "de la", None, "", "4"), (4, "in der", "src2", "5", ""), (5, "no such road", None, "1", "2")]


def _road_queries(spark):
    fields = [f.name for f in parse.PARSED.fields]
    full = [(i, {n: None for n in fields} | {"road": [r], "city": [c] if c else None, "house_number": n, "postcode": p, "country": ""}) for i, r, c, n, p in _ROADS]
    from pyspark.sql.types import LongType, StructField, StructType

    rows = spark.createDataFrame(full, StructType([StructField("query_id", LongType()), StructField("parsed", parse.PARSED)]))
    look = fw.Lookups(literal(spark, [], "label string, aliases array<string>"), literal(spark, _LABELS, "label string, code string"), literal(spark, _LANGUAGES, "code string, languages array<string>"))
    return fw.with_lookups(fw.route(rows), look), look


def _sql_street(langs: list[str], out: str) -> str:
    parts = []
    for lang in langs:
        parts.append(f"""d_{lang} AS (SELECT doc_id AS _id, ' ' || array_to_string({sql_tokens('text', True)}, ' ') || ' ' AS street, source, (doc_id % 100)::VARCHAR AS number, (doc_id % 50)::VARCHAR AS postcode FROM documents WHERE lang = '{lang}'),
n_{lang} AS (SELECT count(*) AS n FROM d_{lang}), fn_{lang} AS (SELECT number, count(*) AS df FROM d_{lang} GROUP BY 1), fp_{lang} AS (SELECT postcode, count(*) AS df FROM d_{lang} GROUP BY 1),
s_{lang} AS (SELECT query_id, d._id, CASE WHEN q.number = d.number THEN ln(1 + (n - fn.df + 0.5) / (fn.df + 0.5)) / 2.2 ELSE 0 END + CASE WHEN q.postcode = d.postcode THEN ln(1 + (n - fp.df + 0.5) / (fp.df + 0.5)) / 2.2 ELSE 0 END AS score
  FROM q JOIN d_{lang} d ON contains(d.street, ' ' || road || ' ') AND (q.city IS NULL OR q.city = d.source) JOIN fn_{lang} fn ON fn.number = d.number JOIN fp_{lang} fp ON fp.postcode = d.postcode, n_{lang}),
b_{lang} AS (SELECT query_id, _id, score, '{lang}' AS src FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, _id) AS rank FROM s_{lang}) WHERE rank = 1)""")
    return f"WITH q(query_id, road, city, number, postcode) AS (VALUES {values(_ROADS)}), " + ",\n".join(parts) + "\n" + out


@query(_sql_street(["en"], "SELECT query_id::BIGINT AS query_id, _id, round(score, 6) AS score FROM b_en"))
def forward_street(spark, sf):
    q, _ = _road_queries(spark)
    return fw.street_hits(q, _streets(spark, sf, "en")).select("query_id", "_id", F.round("score", 6).alias("score"))


@query(_sql_street(["en", "fr"], "SELECT query_id::BIGINT AS query_id, src AS source, q.number FROM (SELECT * FROM b_en UNION ALL SELECT * FROM b_fr WHERE query_id NOT IN (SELECT query_id FROM b_en)) JOIN q USING (query_id)"))
def forward_fallback(spark, sf):
    q, look = _road_queries(spark)
    rows = fw.forward_street(q, [("en", _streets(spark, sf, "en")), ("fr", _streets(spark, sf, "fr"))], look.languages)
    return rows.select("query_id", F.col("location.source").alias("source"), F.col("location.number").alias("number"))


_SQL_STREETS = _sql_street(["en", "fr"], "SELECT query_id, _id, src, q.number FROM (SELECT * FROM b_en UNION ALL SELECT * FROM b_fr WHERE query_id NOT IN (SELECT query_id FROM b_en)) JOIN q USING (query_id)")
_SQL_CITIES = f"""SELECT query_id, min_by(c_mktsegment || ' ' || n_name, rank) AS city, min_by(region, rank) AS region, count(*) - 1 AS more
FROM ({_sql_city(_ASKED)}) JOIN customer ON c_custkey = _id JOIN nation ON c_nationkey = n_nationkey GROUP BY query_id"""


@query(f"""SELECT a.query_id, coalesce(c.city, d.source) AS city, coalesce(c.region, d.source) AS region, CASE WHEN c.city IS NOT NULL THEN 'Geonames' ELSE s.src END AS source,
CASE WHEN c.city IS NOT NULL THEN '' ELSE s.number END AS number, coalesce(c.more, 0)::INT AS more
FROM (SELECT unnest(range(1, {len(_ASKED) + 1}))::BIGINT AS query_id UNION ALL SELECT unnest(range(11, {len(_ROADS) + 11}))::BIGINT) a
LEFT JOIN ({_SQL_CITIES}) c USING (query_id) LEFT JOIN (SELECT query_id + 10 AS query_id, _id, src, number FROM ({_SQL_STREETS})) s USING (query_id) LEFT JOIN documents d ON s._id = d.doc_id""")
def forward_routed(spark, sf):
    """City and street queries together, from their parts to locations."""
    groups = literal(spark, _CITY_ALIASES, "group_no int, labels array<string>")
    look = fw.Lookups(labels.alias_table(groups), literal(spark, _CITY_LABELS, "label string, code string"), literal(spark, _LANGUAGES, "code string, languages array<string>"))
    roads = _road_queries(spark)[0].select((F.col("query_id") + 10).alias("query_id"), "parsed")
    sources = [(lang, _streets(spark, sf, lang)) for lang in ("en", "fr")]
    found = fw.forward(_asked(spark, _ASKED).union(roads), places(spark, sf), sources, look)
    return found.select("query_id", *(F.col(f"location.{c}").alias(c) for c in ("city", "region", "source", "number")), F.size("other").alias("more"))


@query()
def forward_free_text(spark, sf):
    """Free text to location: parsed, looked up, routed, answered."""
    names = parse.Gazetteer.of(["america", "asia", "atlantis"], [], ["household nation_1", "building nation_1", "tower"])
    asked = literal(spark, [(1, "Building NATION_1, America"), (2, "of the street 12, 0007"), (3, "Tower, Atlantis"), (4, " ")], "query_id bigint, address string")
    groups = literal(spark, _CITY_ALIASES, "group_no int, labels array<string>")
    look = fw.Lookups(labels.alias_table(groups), literal(spark, _CITY_LABELS, "label string, code string"), literal(spark, _LANGUAGES, "code string, languages array<string>"))
    found = fw.forward(parse.parsed(asked, names), places(spark, sf), [("en", _streets(spark, sf, "en"))], look)
    return found.select("query_id", F.col("location.city").alias("city"), F.col("location.source").alias("source"), F.size("other").alias("more"))


_FIRST = "coalesce(code, '') <> 'be' AND coalesce(list_has_any(languages, ['en', 'fr']), false)"


@query(f"""WITH g(code, languages) AS (VALUES {values(_LANGUAGES)}),
x AS (SELECT s_suppkey, s_name AS street, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE (s_suppkey % 90)::VARCHAR END AS number, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'u' || s_suppkey END AS unit, ['za', 'us', 'be', 'de', 'fr', 'zz'][s_nationkey % 6 + 1] AS cc FROM supplier)
SELECT s_suppkey, CASE WHEN number = '' THEN street ELSE (CASE WHEN {_FIRST} THEN number || ' ' || street ELSE street || ' ' || number END) || CASE WHEN unit = '' THEN '' ELSE ' ' || unit END END AS full_street_address FROM x LEFT JOIN g ON cc = code""")
def full_street_address(spark, sf):
    codes = F.array(*map(F.lit, ["za", "us", "be", "de", "fr", "zz"]))
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("street"), F.when(key % 4 == 0, "").otherwise((key % 90).cast("string")).alias("number"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("u"), key)).alias("unit"), F.element_at(codes, (F.col("s_nationkey") % 6 + 1).cast("int")).alias("cc"))
    rows = labels.with_languages(rows, "cc", _lookups(spark).languages)
    return rows.select("s_suppkey", address.full_street_address(*map(F.col, ("street", "number", "unit", "cc", "languages"))).alias("full_street_address"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '14' ELSE '' END AS number, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS unit, floor(s_acctbal * 100) / 100 AS floored FROM supplier")
def result_number_unit(spark, sf):
    rows = table(spark, sf, "supplier")
    number, unit = F.when(F.col("s_suppkey") % 2 == 0, "14"), F.when(F.col("s_suppkey") % 3 == 0, "9")
    return rows.select("s_suppkey", address.result_number(number).alias("number"), address.result_unit(F.col("s_name"), unit).alias("unit"), address.floor2(F.col("s_acctbal")).alias("floored"))


#: Fixed inputs.
_FREE_TEXT = [(1, "461 W Main St, Cheshire, 06410"), (2, "Geislersgade 14, 3 th 2300 Copenhagen"), (3, "178 Columbus Avenue; #231573; New York, NY 10023, US, United States"), (4, "Metz, Lorraine, France")]


@query()
def parse_address(spark, sf):
    names = parse.Gazetteer.of(["us", "united states", "france"], ["ny"], ["new york"])
    rows = parse.parsed(literal(spark, _FREE_TEXT, "query_id bigint, address string"), names)
    return rows.select("query_id", "parsed.house_number", "parsed.postcode", "parsed.state", "parsed.country", F.array_join("parsed.road", "|").alias("road"), F.array_join("parsed.city", "|").alias("city"))


@query()
def expand_address(spark, sf):
    rows = literal(spark, [(1, "W Main St"), (2, "Rathsfelder Str")], "query_id bigint, road string")
    return rows.select("query_id", F.explode(parse.spellings(F.col("road"), F.array(F.lit("en"), F.lit("de")))).alias("spelling"))


@query(r"SELECT p_partkey, replace(replace(replace(p_name || '(1)/a-b', '/', '\/'), '(', '\('), ')', '\)').replace('-', '\-') AS escaped FROM part")
def escape_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.escaped(F.concat("p_name", F.lit("(1)/a-b"))).alias("escaped"))


@query("""SELECT p_partkey, replace(replace(concat(p_name, chr(39), chr(92), p_brand), chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) AS quoted,
(p_size > 25)::INT::VARCHAR AS digit FROM part""")
def quote_bool_digit(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", text.quoted(F.concat("p_name", F.lit("'\\"), "p_brand")).alias("quoted"), text.bool_digit(F.col("p_size") > 25).alias("digit"))


# ---- files: the tables written out in a source's format, and read back

def _columns(width: int, held: dict):
    return [(held[i] if i in held else F.lit("x")).cast("string").alias(f"c{i}") for i in range(width)]


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS city, c_custkey % 90 + 0.5::DOUBLE AS lat, -(c_custkey % 180) - 0.25::DOUBLE AS long, 'n' || c_nationkey AS country_code,
CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey * 3 END::BIGINT AS population, 'Geonames' AS source FROM customer WHERE c_mktsegment = 'BUILDING'""")
def read_geonames(spark, sf):
    key = F.col("c_custkey")
    held = {0: key, 1: F.col("c_name"), 4: key % 90 + 0.5, 5: -(key % 180) - 0.25, 6: F.when(F.col("c_mktsegment") == "BUILDING", "P").otherwise("S"), 8: F.concat(F.lit("N"), "c_nationkey"), 14: F.when(key % 7 == 0, "none").otherwise((key * 3).cast("string"))}
    at = new_folder(spark, "geonames")
    table(spark, sf, "customer").select(*_columns(19, held)).write.csv(at, sep="\t", quote="")
    return readers.geonames(spark, at)


@query("""SELECT postcode || city || street || number || country_code AS id, postcode, city, street, number, lat, long, country_code, 'OpenStreetDataAddress' AS source
FROM (SELECT (s_suppkey % 50)::VARCHAR AS postcode, 'City ' || s_nationkey AS city, s_name AS street, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_suppkey::VARCHAR END AS number,
s_suppkey / 8 AS lat, -s_suppkey / 4 AS long, 'xx' AS country_code FROM supplier)""")
def read_houses(spark, sf):
    key = F.col("s_suppkey")
    number = F.when(key % 5 != 0, key.cast("string"))
    held = {0: key % 50, 1: F.concat(F.lit("City "), "s_nationkey"), 2: F.col("s_name"), 3: number, 4: -key / 4, 5: key / 8, 6: F.lit("XX")}
    at = new_folder(spark, "houses")
    table(spark, sf, "supplier").select(*_columns(7, held)).write.csv(at, sep="\t", header=True, compression="gzip", quote="")
    return readers.houses(spark, at)


# ---- streams

def _landing(spark, sf):
    """The events as messages in a folder of their own; every fifth line is cut, every seventh has an unknown source."""
    root = new_folder(spark, "ingest")
    rows = table(spark, sf, "events")
    loc = F.struct(F.concat(F.lit("u"), "user_id").alias("id"), F.col("event_type").alias("city"), F.lit("xx").alias("country_code"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("long"), F.col("event_id").alias("population"), F.when(F.col("event_id") % 7 == 0, "Elsewhere").otherwise("Geonames").alias("source"))
    line = F.to_json(F.struct(F.array(loc).alias("locations")))
    bad = F.when(F.col("event_id") % 5 == 0, F.substring(line, 1, 30)).otherwise(line)
    # One sorted file: arrival order decides which write is the last.
    rows.select("event_id", bad.alias("value")).orderBy("event_id").coalesce(1).select("value").write.text(f"{root}/in")
    return root


def _run_stream(spark, sf):
    root = _landing(spark, sf)
    store = keyed.Store(spark, f"{root}/store")
    store.create("geonames_cities")
    ingest.ingest(store, f"{root}/in", f"{root}/checkpoint", f"{root}/quarantine", once=True).awaitTermination()
    return root, store


@query("SELECT 'u' || user_id AS _id, arg_max(event_type, event_id) AS city, max(event_id)::INT AS population FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY user_id")
def stream_ingest(spark, sf):
    _, store = _run_stream(spark, sf)
    return store.read("geonames_cities").select("_id", "city", "population")


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'undecodable' ELSE 'unsupported source' END AS bad, count(DISTINCT CASE WHEN event_id % 5 = 0 THEN left('{\"locations\":[{\"id\":\"u' || user_id || '\",\"city\":\"' || event_type || '\"', 30) ELSE event_id::VARCHAR END)::BIGINT AS n FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0 GROUP BY 1")
def stream_deadletter(spark, sf):
    root, _ = _run_stream(spark, sf)
    return spark.read.json(f"{root}/quarantine").groupBy("bad").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable]:
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
