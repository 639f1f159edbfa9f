import json

import pytest
from pyspark.sql import functions as F

from terravane.functions import text
from terravane.operators import postings, search as s


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "Main Street", "a", 5, None), (2, "W Main St", "b", 10, "x"), (3, "Mainz", None, 7, "y"), (4, None, "a", None, None), (5, "main main street", "c", 9, "x")]
    return spark.createDataFrame(data, "id int, name string, kind string, n int, tag string")


def ids(frame):
    return sorted(r.id for r in frame.collect())


def find(rows, body):
    return ids(s.matching(s.Corpus(rows, {"name": text.tokens_folded}), body))


def test_no_clauses_match_all(rows):
    assert find(rows, s.Search()) == [1, 2, 3, 4, 5]


def test_range_takes_the_upper_bound_first(rows):
    assert find(rows, s.Search().filter_range("n", 10, 5)) == [1, 3, 5]
    assert find(rows, s.Search().filter_range("n", "", 9)) == [2, 5]
    assert find(rows, s.Search().filter_range("n")) == [1, 2, 3, 5]


def test_exclusions_let_nulls_pass(rows):
    assert find(rows, s.Search().must_not_term("kind", "a")) == [2, 3, 5]
    assert find(rows, s.Search().must_not_terms("kind", ["a", "b"])) == [3, 5]
    assert find(rows, s.Search().must_not_exists("kind")) == [3]


def test_lists_are_cut(spark):
    values = [str(i) for i in range(70_000)]
    assert len(s.Search().filter_terms("k", values).filters[0].value) == 65_536
    assert len(s.Search().must_not_terms("k", values).nots[0].value) == 65_536
    assert len(s.Search().must_terms("k", values).musts[0].value) == 65_536


def test_phrase_and_any(rows):
    assert find(rows, s.Search().filter_match_phrase("name", "MAIN st")) == [2]
    assert find(rows, s.Search().filter_match("name", "street st")) == [1, 2, 5]
    assert find(rows, s.Search().filter_match_phrase("name", " -- ")) == []


def test_minimum_defaults(rows):
    assert find(rows, s.Search().should_term("kind", "a").should_term("tag", "x")) == [1, 2, 4, 5]
    assert find(rows, s.Search().filter_exists("n").should_term("kind", "a")) == [1, 2, 3, 5]
    assert find(rows, s.Search().filter_exists("n").should_term("kind", "a").minimum_should_match(1)) == [1]
    assert find(rows, s.Search().should_term("kind", "a").should_term("n", 5).minimum_should_match(2)) == [1]
    assert find(rows, s.Search().should_term("kind", "a").minimum_should_match("0")) == [1, 2, 3, 4, 5]


def test_nested_bool_and_raw(rows):
    inner = s.Search().should_term("kind", "b").should_raw("n = 7").minimum_should_match(1)
    assert find(rows, s.Search().filter_custom(inner)) == [2, 3]
    assert find(rows, s.Search().filter_raw(F.col("n") > 8)) == [2, 5]
    assert find(rows, s.Search().must_range("n", 8, 6)) == [3]
    assert find(rows, s.Search().should_match_phrase("name", "main street").should_match("name", "mainz").should_custom(s.Search().filter_term("kind", "b"))) == [1, 2, 3, 5]


def test_wildcards(rows):
    assert find(rows, s.Search().wild_card("name", "Main?")) == [3]
    assert find(rows, s.Search().wild_card("kind", "?")) == [1, 2, 4, 5]
    assert s.wildcard_regex("a.b*") == r"^a\.b.*$"


def test_scores_follow_bm25(rows):
    hits = s.search(s.Corpus(rows, {"name": text.tokens_folded}), s.Search().should_match("name", "main"), "id").rows.collect()
    assert [r.id for r in hits][0] == 5 and all(r._score > 0 for r in hits) and len(hits) == 3
    many = postings.bm25(rows.where("name is not null").select("id", text.tokens_folded(F.col("name")).alias("t")), "id", "t", rows.sparkSession.createDataFrame([(1, ["main"])], "q int, w array<string>"), "q", "w")
    one = {r.id: r._score for r in hits}
    full = s.Corpus(rows.where("name is not null"), {"name": text.tokens_folded})
    again = {r.id: r._score for r in s.search(full, s.Search().should_match("name", "main"), "id").rows.collect()}
    assert {r.id: round(r.score, 9) for r in many.collect()} == {k: round(v, 9) for k, v in again.items()} and set(one) == set(again)


def test_order_paging_and_total(rows):
    hits = s.search(rows, s.Search(), "id", size=2, start=1, sort=["n:desc"], includes=["id"], track_total=True)
    assert [r.id for r in hits.rows.collect()] == [5, 3] and hits.total == 5
    last = s.search(rows, s.Search(), "id", size=9, sort=["n:desc"]).rows.collect()
    assert last[-1].id == 4  # missing values come last
    assert [r.id for r in s.search(rows, s.Search().sort("n", "asc").search_after(7, 3), "id").rows.collect()] == [5, 2]
    assert s.Search().sort("a", "asc").sort("b", "desc").sort("c").sorts == [("c", "asc")]


def test_min_score_and_functions(rows):
    assert ids(s.search(rows, s.Search().should_exists("tag").should_exists("kind").min_score(2), "id").rows) == [2, 5]
    scored = s.search(rows, s.Search().match_all().function_score_script("n"), "id").rows.collect()
    assert scored[0]._score == 10.0
    rand = s.search(rows, s.Search().match_all().function_score_random(3), "id").rows.collect()
    assert all(0.5 <= r._score <= 1 for r in rand)


def test_collapse_keeps_best_and_members(rows):
    best = s.search(rows, s.Search().filter_exists("tag").collapse("tag", "id"), "id", sort=["n:desc"]).rows.collect()
    assert [(r.id, [m.id for m in r.inner_hits]) for r in best] == [(2, [2, 5]), (3, [3])]


def test_nested_and_children(spark):
    parents = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, [(3, "a")]), (3, [])], "id int, items array<struct<n: int, t: string>>")
    assert ids(s.matching(parents, s.Search().filter_nested("items", s.Search().filter_term("items.t", "a").filter_range("items.n", "", 2)))) == [2]
    hit = s.search(parents, s.Search().filter_nested("items", s.Search().filter_term("t", "a"), ["n"]), "id", sort=["id:asc"]).rows.collect()
    assert [[x.n for x in r.items_inner_hits] for r in hit] == [[1], [3]]
    kids = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "p int, v int")
    for mode, want in (("none", 1.0), ("min", 1.0), ("sum", 2.0), ("avg", 1.0), ("max", 1.0)):
        rows = s.search(parents, s.Search().has_child(kids, "id", "p", s.Search().must_range("v", "", 5), mode), "id").rows.collect()
        assert [(r.id, r._score) for r in rows] == [(1, want)], mode


def test_statistics(rows):
    found = {r.field: r for r in s.statistics(rows, ["n"], s.Search().filter_exists("name")).collect()}
    assert (found["n"]["count"], found["n"]["min"], found["n"]["max"], found["n"]["sum"]) == (4, 5.0, 10.0, 31.0)


def test_body_is_plain_data():
    body = s.Search().filter_term("a", 1).filter_custom(s.Search().should_term("b", 2)).minimum_should_match(1)
    assert json.loads(body.debug())["minimum_should_match"] == 1 and "should" in body.debug()


def test_tokens(spark):
    one = lambda f, t: spark.range(1).select(f(F.lit(t))).first()[0]
    assert one(text.tokens_folded, "Kalvebod Brygge 1-3; KØBENHAVN Straße o'Neil 9.5") == ["kalvebod", "brygge", "1", "3", "kobenhavn", "strasse", "o'neil", "9.5"]
    assert one(text.tokens_standard, "København 港区 ひが") == ["københavn", "港", "区", "ひ", "が"]
    assert one(text.escaped, "a(b)'\\") == "a\\(b\\)\\'\\\\" and one(text.quoted, "a'\\") == "a\\'\\\\"


def test_filters_reach_the_scan(spark):
    plan = s.matching(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), s.Search().filter_term("o_orderstatus", "F").filter_range("o_totalprice", 5.0, 1.0)).select("o_orderkey")
    text_ = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in text_ and "o_custkey" not in text_.split("ReadSchema")[1]
