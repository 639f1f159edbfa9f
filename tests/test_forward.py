"""Parsing, forward search and streaming ingest."""

import json

import pytest
from pyspark.sql import functions as F

from terravane.functions import labels
from terravane.operators import keyed
from terravane.plans import forward as fw, parse
from terravane.schema import ADDRESS_DOC, CITY_DOC
from terravane.streaming import ingest

NAMES = parse.Gazetteer.of(
    ["us", "united states", "usa", "united kingdom", "gb", "denmark", "dk", "france", "fr", "china", "mexico", "mx", "netherlands", "nl", "italy", "jp", "se", "de"],
    ["ny", "kansas", "florida", "lorraine", "veneto", "michigan", "ca"],
    ["nyc", "brooklyn", "london", "metz", "copenhagen"],
)


def parsed(t):
    return {k: v for k, v in parse.assemble(parse.components(t, NAMES)).items() if v}


@pytest.mark.parametrize("text, want", [
    ("461 W Main St, Cheshire, 06410", {"house_number": "461", "road": ["w main st"], "city": ["cheshire"], "postcode": "06410"}),
    ("Geislersgade 14, 4 2300 Copenhagen", {"house_number": "14", "road": ["geislersgade"], "unit": "4", "postcode": "2300", "city": ["copenhagen"]}),
    ("Geislersgade 14, 3 th 2300 Copenhagen", {"house_number": "14", "road": ["geislersgade"], "unit": "3 th", "postcode": "2300", "city": ["copenhagen"]}),
    ("178 Columbus Avenue; #231573; New York, NY 10023, US, United States", {"house_number": "178", "road": ["columbus avenue"], "unit": "#231573", "city": ["new york"], "state": "ny", "postcode": "10023", "country": "united states"}),
    ("Lawrence, Kansas, United States", {"city": ["lawrence"], "state": "kansas", "country": "united states"}),
    ("Metz, Lorraine, France", {"city": ["metz"], "state": "lorraine", "country": "france"}),
    ("Arnhem, NL, Netherlands", {"city": ["arnhem"], "country": "netherlands"}),
    ("Wellington, Florida 33614, US, United States", {"city": ["wellington"], "state": "florida", "postcode": "33614", "country": "united states"}),
    ("485 Madison Avenue; 10th Floor; New York, NY 10022, US", {"house_number": "485", "road": ["madison avenue"], "level": "10th floor", "city": ["new york"], "state": "ny", "postcode": "10022", "country": "us"}),
    ("Kalvebod Brygge 1-3; København Denmark", {"road": ["kalvebod brygge"], "house_number": "1-3", "city": ["københavn"], "country": "denmark"}),
    ("Metz", {"city": ["metz"]}),
    ("5840 Autoport Mall; San Diego, California 92121, us", {"house_number": "5840", "road": ["autoport mall"], "city": ["san diego"], "state": "california", "postcode": "92121", "country": "us"}),
])
def test_grammar(text, want):
    assert parsed(text) == want


def test_parser_on_columns(spark):
    rows = parse.parsed(spark.createDataFrame([(1, "Metz"), (2, "  "), (3, None)], "query_id long, address string"), NAMES).collect()
    assert [(r.query_id, r.parsed.city, r.parsed.road) for r in rows] == [(1, ["metz"], None)]
    with pytest.raises(ValueError):
        parse.assemble([("planet", "earth")])
    assert parse.without([("road", "a"), ("city", "b")], "road") == "b"
    own = parse.parsed(spark.createDataFrame([(1, "x")], "query_id long, address string"), NAMES, backend=lambda s: [("road", s), ("road", "y"), ("unit", "1"), ("unit", "2")])
    assert own.first().parsed.road == ["x", "y"] and own.first().parsed.unit == "2"


def test_spellings(spark):
    def of(road, *langs):
        return set(spark.range(1).select(parse.spellings(F.lit(road), F.array(*map(F.lit, langs)).cast("array<string>"))).first()[0])

    assert of("W Main St", "en") == {"w main st", "w main street", "w main saint", "west main st", "west main street", "west main saint"}
    assert of("Hauptstr", "de") == {"hauptstr"} and of("X Str", "de") == {"x str", "x straße", "x strasse"} and of("A St") == {"a st"}


@pytest.fixture(scope="module")
def lookups(spark):
    groups = spark.createDataFrame([(0, ["nyc", "x"]), (1, ["nyc", "new york city"])], "group_no int, labels array<string>")
    names = spark.createDataFrame([("united states", "us"), ("denmark", "dk"), ("france", "fr")], "label string, code string")
    return fw.Lookups(labels.alias_table(groups), names, spark.createDataFrame([("us", ["en"]), ("dk", ["da"]), ("fr", ["fr"])], "code string, languages array<string>"))


@pytest.fixture(scope="module")
def cities(spark):
    rows = [("1", "New York City", "NY", "us", (40.7, -74.0), 800), ("2", "Paris", "TX", "us", (33.6, -95.5), 25), ("3", "Paris", "IDF", "fr", (48.8, 2.3), 2000), ("4", "Aarhus", "", "dk", (56.1, 10.2), 300), ("5", "Odense", "", "dk", (55.4, 10.4), 200), ("6", "Paris", "", "dk", (1.0, 1.0), 2), ("7", "Parisville", "", "us", (1.0, 1.0), 9000)]
    return spark.createDataFrame(rows, CITY_DOC)


def addresses(spark, rows):
    full = [(i, city, region, street, number, unit, None, postcode, cc, (1.5, 2.5)) for i, street, number, unit, city, region, postcode, cc in rows]
    return spark.createDataFrame(full, ADDRESS_DOC)


@pytest.fixture(scope="module")
def sources(spark):
    one = [("a", "Main Street", "12", "3B", "New York City", "NY", "10001", "us"), ("b", "Main Street", "14", None, "New York City", "NY", "10002", "us"), ("c", "W Main Street", "1", "10001", "New York City", None, None, "us"), ("d", "Hillerødgade", "1", None, "København", None, "2300", "dk")]
    two = [("z", "Rue Bleue", "5", None, "Paris", None, "75001", "fr"), ("y", "Main Street", "14", None, "New York City", "NY", "10002", "us")]
    return [("OpenAddresses", addresses(spark, one)), ("OpenStreetDataAddress", addresses(spark, two))]


QUERIES = {
    1: [], 2: [("house", "tower")], 3: [("road", "main st")], 4: [("road", "main street"), ("country", "atlantis")],
    5: [("city", "paris")], 6: [("city", "paris"), ("country", "france")], 7: [("country", "denmark")], 8: [("country", "atlantis")],
    9: [("city", "nyc"), ("state", "a")], 10: [("city", "nyc"), ("state", "b")], 11: [("road", "main st"), ("country", "united states"), ("house_number", "14"), ("unit", "9"), ("city", "nyc")],
    12: [("road", "main street"), ("postcode", "10001"), ("country", "us"), ("unit", "1")], 13: [("road", "rue bleue"), ("house_number", "7"), ("country", "france")], 14: [("road", "hillerodgade"), ("house_number", "3")], 15: [("city", "københavn"), ("country", "us")],
}


@pytest.fixture(scope="module")
def answers(spark, lookups, cities, sources):
    text = spark.createDataFrame([(k, str(k)) for k in QUERIES], "query_id long, address string")
    rows = parse.parsed(text, NAMES, backend=lambda s: QUERIES[int(s)])
    return {r.query_id: r for r in fw.forward(rows, cities, sources, lookups).collect()}


def test_nothing_asked_nothing_found(answers):
    assert all(answers[k].location is None and answers[k].other == [] for k in (1, 2, 4, 15)) and len(answers) == len(QUERIES)


def test_cities(answers):
    assert [answers[5].location.country_code, *(x.country_code for x in answers[5].other)] == ["fr", "us", "dk"]
    assert answers[6].location.region == "IDF" and answers[6].other == []
    assert answers[7].location.city == "Aarhus" and len(answers[8].other) == 4 and answers[8].location.city == "Parisville"
    assert answers[9].location == answers[10].location and answers[9].location.city == "New York City"


def test_streets(answers):
    a = answers[11].location
    assert (a.number, a.unit, a.source, a.full_street_address, a.postcode) == ("14", "", "OpenAddresses", "14 Main Street", "10002")
    assert answers[3].location.street == "Main Street" or answers[3].location.street == "W Main Street"
    assert answers[12].location.street in ("Main Street", "W Main Street") and answers[12].location.number == ""
    assert answers[13].location.source == "OpenStreetDataAddress" and answers[13].location.full_street_address == "7 Rue Bleue"
    assert answers[14].location.city == "København" and answers[14].location.full_street_address == "Hillerødgade 3"


def line(*locs):
    return json.dumps({"locations": list(locs)})


def city(i, pop, source="Geonames"):
    return {"id": i, "city": "C" + i, "lat": 1.0, "long": 2.0, "country_code": "xx", "population": pop, "source": source}


def test_stream(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "store"))
    for t in ("geonames_cities", "openaddresses", "openstreetdata_addresses"):
        store.create(t)
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda **k: ingest.ingest(store, str(inbox), str(tmp_path / "cp"), str(tmp_path / "bad"), once=True, **k).awaitTermination()
    (inbox / "1.txt").write_text("\n".join([line(city("a", 1), city("a", 2), city("b", 3)), "{broken", line(city("q", 1, "Unknown")), line(city("s", 1, "OpenStreetDataStreet")), line(city("o", 1, "OpenAddresses")), line(city("n", 9, 1))]))
    run()
    got = {r._id: r.population for r in store.read("geonames_cities").collect()}
    assert got == {"a": 2, "b": 3, "n": 9} and store.read("openaddresses").count() == 1
    bad = spark.read.json(str(tmp_path / "bad")).groupBy("bad").count().collect()
    assert {r.bad: r["count"] for r in bad} == {"undecodable": 1, "unsupported source": 2}
    (inbox / "2.txt").write_text(line(city("a", 1), city("a", 2), city("b", 3)))
    run()
    assert {r._id: r.population for r in store.read("geonames_cities").collect()} == got


def test_stream_retries_once(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "store"))
    calls = []

    def fails(times):
        def insert(rows):
            calls.append(rows.count())
            if len(calls) <= times:
                raise RuntimeError("down")

        return insert

    lines = spark.createDataFrame([(line(city("a", 1)),)], "value string")
    ingest.ingest_batch(store, lines, 0, str(tmp_path / "bad"), fails(1))
    assert calls == [1, 1] and not (tmp_path / "bad").exists()
    calls.clear()
    ingest.ingest_batch(store, lines, 1, str(tmp_path / "bad"), fails(9))
    assert calls == [1, 1] and spark.read.json(str(tmp_path / "bad")).first().bad == "store: RuntimeError"


def test_enqueue_round_trip(spark, tmp_path):
    from terravane.schema import LOCATION

    rows = spark.createDataFrame([("a", None, None, None, "C", None, None, None, 1.0, 2.0, "xx", "Geonames", 5, None)], LOCATION)
    ingest.enqueue(rows, str(tmp_path / "in"))
    ingest.enqueue(rows.limit(0), str(tmp_path / "in"))
    back = ingest.decoded(spark.read.text(str(tmp_path / "in"), recursiveFileLookup=True)).collect()
    assert [(r.id, r.city, r.bad) for r in back] == [("a", "C", None)]
