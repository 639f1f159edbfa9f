"""Keyed tables, lookups, space and sources."""

import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane import schema
from terravane.functions import address, geo, labels
from terravane.operators import keyed, spatial
from terravane.plans import registry
from terravane.sources import readers

LOC = "id string, street string, number string, unit string, city string, district string, region string, postcode string, lat double, long double, country_code string, population long, n int"


def loc(i, n, city="X", lat=1.0, cc="xx", street="s", pop=None):
    return (i, street, "1", "", city, "", "", "", lat, 2.0, cc, pop, n)


def test_store_upserts_by_key(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "store"))
    store.create("openaddresses")
    store.create("openaddresses")
    store.insert_addresses(spark.createDataFrame([loc("a", 1), loc("a", 2, "Y"), loc("b", 3), loc("c", 4, lat=90.0), loc("d", 5, lat=90.0001)], LOC), "OpenAddresses", "n")
    rows = {r._id: r for r in store.read("openaddresses").collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"].city == "Y" and rows["a"].unit is None
    store.insert_addresses(spark.createDataFrame([loc("b", 1, "Z", cc="yy"), loc("e", 2)], LOC), "OpenAddresses", "n")
    store.insert_addresses(spark.createDataFrame([], LOC), "OpenAddresses", "n")
    rows = {r._id: r for r in store.read("openaddresses").collect()}
    assert set(rows) == {"a", "b", "c", "e"} and rows["b"].city == "Z" and rows["b"].country_code == "yy"
    assert store.settings("openaddresses")["version"] == 3
    with pytest.raises(ValueError):
        store.insert_addresses(spark.createDataFrame([], LOC), "OpenStreetDataStreet")
    with pytest.raises(ValueError):
        store.upsert("openaddresses", spark.createDataFrame([("a", 1)], "_id string, colour int"))
    store.delete("openaddresses")
    assert not store.exists("openaddresses")


def test_cities_keep_blanks_and_bad_coordinates(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "store"))
    store.create("geonames_cities")
    store.insert_cities(spark.createDataFrame([loc("a", 1, city="", lat=99.0)], LOC), "n")
    row = store.read("geonames_cities").first()
    assert row.city == "" and row.location.lat == 99.0 and row.population == 0


def test_versions_and_routing(spark):
    base, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 5), (2, 5)], [(1, 4), (2, 6), (3, 1)]))
    assert sorted(r.k for r in keyed.newer_versions(base, new, "k", "v").collect()) == [2, 3]
    assert keyed.with_routing(spark.createDataFrame([(1, "a")], "k int, _routing string"), 3).columns == ["k"]
    doc = keyed.as_json(spark.createDataFrame([("1", None, "x")], "_id string, a string, b string")).first()
    assert json.loads(doc.doc) == {"b": "x"}
    with pytest.raises(ValueError):
        schema.check_strict(["nope"], schema.CITY_DOC)


def test_lookups(spark):
    table = labels.alias_table(spark.createDataFrame([(0, ["nyc", "new york"]), (1, ["nyc", "big apple"])], "group_no int, labels array<string>"))
    rows = labels.with_aliases(spark.createDataFrame([("NYC",), ("Metz",)], "c string"), "c", table).collect()
    assert {r.c: r.aliases for r in rows} == {"NYC": ["nyc", "big apple"], "Metz": ["metz"]}
    names = spark.createDataFrame([("denmark", "dk"), ("danmark", "dk"), ("france", "fr")], "label string, code string")
    asked = spark.createDataFrame([(x,) for x in ("DK", "Danmark", "denmark", "xx", "France")], "c string")
    assert {r.c: r.country_code for r in labels.with_country_code(asked, "c", names).collect()} == {"DK": "dk", "Danmark": "dk", "denmark": "dk", "xx": "", "France": "fr"}


def test_generators(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"DK": {"name": "Denmark", "native": "Danmark", "languages": ["DA"]}, "AQ": {"name": "Antarctica", "native": "Antarctica", "languages": []}}))
    data = labels.countries(spark, str(tmp_path / "c.json"))
    assert {(r.label, r.code) for r in labels.country_labels(data).collect()} == {("denmark", "dk"), ("danmark", "dk"), ("antarctica", "aq"), ("usa", "us")}
    langs = labels.country_languages(data)
    assert {r.code: r.languages for r in langs.collect()} == {"dk": ["da"], "aq": []}
    cities = spark.createDataFrame([("1", "Copenhagen", "DK"), ("2", "Base", "AQ")], "id string, name string, country string")
    names = spark.createDataFrame([("1", "da", "København", 2), ("1", "fr", "Copenhague", 1), ("1", "da", "Kbh", 3), ("1", "da", "COPENHAGEN", 0)], "id string, iso string, name string, pos int")
    groups = {r.group_no: r.labels for r in labels.city_groups(cities, names, langs).collect()}
    assert groups[1] == ["copenhagen", "københavn", "kbh"] and len(groups) == 3 and any("nyc" in g for g in groups.values())


def test_formatting(spark):
    rows = [("Main", "12", "5", "us", ["en"]), ("Rue", "3", "", "fr", ["fr"]), ("Laan", "4", "", "be", ["nl", "fr"]), ("Gade", "14", "2", "dk", ["da"]), ("X", "", "5", "us", ["en"]), ("Y", "1", "", "", None)]
    t = spark.createDataFrame(rows, "s string, n string, u string, c string, l array<string>")
    got = [r[0] for r in t.select(address.full_street_address(*map(F.col, "snucl"))).collect()]
    assert got == ["12 Main 5", "3 Rue", "Laan 4", "Gade 14 2", "X", "Y 1"]
    assert spark.range(1).select(address.result_unit(F.lit("3B"), F.lit("")), address.result_unit(F.lit("3B"), F.lit("9")), address.floor2(F.lit(12.349))).first()[:] == ("", "3B", 12.34)
    assert spark.range(1).select(address.concat_id(F.lit("a"), F.lit(None), F.lit("b"))).first()[0] == "ab"


def test_vincenty_and_haversine(spark):
    # Flinders Peak to Buninyon, a published example on another ellipsoid's neighbour: within a kilometre of 54972 m.
    d = geo.vincenty_metres([-37.95103341666667, 0.0], [144.42486788888888, 0.0], [-37.65282113888889, 0.5], [143.92649552777777, 179.7])
    assert abs(d[0] - 54972) < 5 and np.isnan(d[1])
    assert geo.vincenty_metres([1.0], [2.0], [1.0], [2.0])[0] == 0
    assert abs(spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0] - 111195) < 1


def zone_rows(spark, points):
    return {r.id: r.z for r in spatial.zone_names(spark.createDataFrame(points, "id int, x double, y double"), registry._zones(spark), "id", "x", "y", 5.0, out="z").collect()}


def test_zones(spark):
    got = zone_rows(spark, [(1, -20.0, 0.0), (2, 1.0, 0.0), (3, -1.0, 0.0), (4, 0.0, 0.0), (5, 0.0, -31.0), (6, 9.0, -31.0), (7, 30.0, 0.0), (8, -30.0, 10.0), (9, 24.0, 26.0), (10, -24.0, 40.0), (11, 200.0, 0.0), (12, -30.0, -30.0)])
    assert got == {1: "west", 2: "east", 3: "west", 4: "west", 5: "", 6: "ring", 7: "", 8: "", 9: "isles", 10: "isles", 11: "", 12: ""}


def test_zone_country_and_wide_zones(spark):
    zones = registry._zones(spark).withColumn("country_code", F.when(F.col("id") == "east", "yy").otherwise("xx"))
    p = spark.createDataFrame([(1, 1.0, 0.0, "XX"), (2, 1.0, 0.0, "YY"), (3, 1.0, 0.0, "zz")], "id int, x double, y double, c string")
    for width in (5.0, 0.01):  # the small grid makes all zones wide
        assert {r.id: r.z for r in spatial.zone_names(p, zones, "id", "x", "y", width, ("c", "country_code"), out="z").collect()} == {1: "west", 2: "east", 3: ""}


def test_zone_names_by_vincenty(spark):
    p = spark.createDataFrame([(1, 1.0, 0.0)], "id int, x double, y double")
    assert spatial.zone_names(p, registry._zones(spark), "id", "x", "y", metres=geo.vincenty, out="z").first().z == "east"


def test_countries_and_fallback(spark):
    zones = registry._zones(spark).withColumn("country_code", F.col("id"))
    p = spark.createDataFrame([(1, -20.0, 0.0), (2, -30.001, 10.0), (3, -35.0, 10.0), (4, -30.0, 10.0)], "id int, x double, y double")
    got = {r.id: r.country for r in spatial.country_codes(p, zones, "id", "x", "y", remap={"west": "ww"}).collect()}
    assert got == {1: "ww", 2: "ww", 3: "", 4: ""}
    both = spatial.all_zones(p, zones, zones.withColumn("country_code", F.lit("west")), zones.limit(0), "id", "x", "y").where("id in (1, 3)")
    assert {r.id: (r.country, r.region, r.locality) for r in both.collect()} == {1: ("west", "west", ""), 3: ("", "", "")}


def test_ways(spark):
    nodes = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)], "id long, lat double, long double")
    ways = spark.createDataFrame([(9, [3, 1, 3])], "id long, nodes array<long>")
    assert [p.lat for p in spatial.way_points(ways, nodes).first().points] == [5.0, 1.0, 5.0]


def test_centroid_of_a_ring_with_a_hole(spark):
    c = {r.id: r.c for r in registry._zones(spark).select("id", geo.centroid(F.col("polygons")).alias("c")).collect()}
    assert abs(c["ring"].y + 31) < 1e-9 and abs(c["isles"].x) < 1e-9


def test_geojson_collections(spark, tmp_path):
    feature = lambda h, g: json.dumps({"type": "Feature", "properties": {"hash": h, "street": "S", "number": None}, "geometry": g})
    point = {"type": "Point", "coordinates": [2.5, 1.5]}
    lines = "\n".join([feature("1", point), feature("2", None), feature("3", {"type": "Polygon", "coordinates": []})])
    root = tmp_path / "oa"
    for name in ("DK/a-addresses-city.geojson", "fr/b-buildings-city.geojson", "fr/readme.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(lines)
    with zipfile.ZipFile(tmp_path / "oa.zip", "w") as z:
        for name in ("DK/a-addresses-city.geojson", "fr/b-parcels-town.geojson", "../evil.geojson"):
            z.writestr(name, lines)
    for rows in (readers.openaddresses(spark, str(root)), readers.openaddresses_zip(spark, str(tmp_path / "oa.zip"))):
        (r,) = rows.collect()
        assert (r.id, r.street, r.number, r.lat, r.long, r.country_code) == ("1", "S", "", 1.5, 2.5, "DK")


def test_tab_separated_sources(spark, tmp_path):
    place = lambda i, cls, pop: "\t".join([str(i), 'Na"me', "", "", "1.5", "2.5", cls, "", "DK", "", "", "", "", "", pop, "", "", "", ""])
    (tmp_path / "g.txt").write_text("\n".join([place(1, "P", "7"), place(2, "A", "8"), place(3, "P", "")]))
    rows = {r.id: r for r in readers.geonames(spark, str(tmp_path / "g.txt")).collect()}
    assert set(rows) == {"1", "3"} and rows["3"].population == 0 and rows["1"].city == 'Na"me' and rows["1"].country_code == "dk"
    assert [r.id for r in readers.geonames(spark, str(tmp_path / "g.txt"), legacy_header=True).collect()] in ([], ["3"])
    with gzip.open(tmp_path / "h.gz", "wt") as f:
        f.write("pc\tcity\tstreet\tnumber\tlon\tlat\tcc\n2300\tCph\tGade\t14\t12.5\t55.5\tDK\n")
    (h,) = readers.houses(spark, [str(tmp_path / "h.gz")]).collect()
    assert (h.id, h.lat, h.long) == ("2300CphGade14dk", 55.5, 12.5)
    with gzip.open(tmp_path / "s.gz", "wt") as f:
        f.write("x\n" + "\t".join(["2300", "Cph", "Gade", "12.1", "12.2", "55.1", "55.2", "1", "9", "True", "False"]) + "\n")
    r = readers.region_corner(readers.street_ranges(spark, [str(tmp_path / "s.gz")], "DK")).first()
    assert (r.house_odd, r.house_even, r.corner_lat, r.corner_long, r.id) == (True, False, 55.1, 12.2, "2300CphGade19dk")
    (tmp_path / "t.tsv").write_text("1\ta\n2\tb\n")
    assert readers.tsv_all(spark, str(tmp_path / "t.tsv"), "i int, s string").count() == 2


def test_map_extracts(spark):
    full = {"addr:street": "S", "addr:city": "C", "addr:housenumber": "1"}
    nodes = spark.createDataFrame([(1, 1.0, 2.0, full), (2, 1.0, 2.0, {**full, "addr:postcode": "9"}), (3, 1.0, 2.0, {"addr:street": "S"})], "id long, lat double, long double, tags map<string, string>")
    rows = readers.osm_addresses(nodes).collect()
    assert {(r.node, r.postcode) for r in rows} == {(1, ""), (2, "9")} and len({r.id for r in rows}) == 2
    ways = spark.createDataFrame([(1, [1], {"name": "N", "highway": "residential"}), (2, [1], {"name": "N", "highway": "primary"}), (3, [1], {"highway": "residential"})], "id long, nodes array<long>, tags map<string, string>")
    assert [r.id for r in readers.osm_streets(ways).collect()] == [1]


def test_zone_files(spark, tmp_path):
    def line(i, lat, path):
        cells = [""] * 26
        cells[9], cells[14], cells[15], cells[17], cells[19], cells[25], cells[12] = str(i), lat, "5", f"zone {i}", path, "DK", "DK"
        return ",".join(cells)

    meta = tmp_path / "meta.csv"
    meta.write_text("\n".join([",".join(f"c{i}" for i in range(26)), line(1, "4", "1/1.geojson"), line(2, "0", "2/2.geojson"), line(3, "0", "3/3.geojson"), line(4, "0", "4/missing.geojson")]).replace(",0,5,", ",0,0,"))
    square = [[[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]]
    for i, g in ((1, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}}), (2, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [square]}}), (3, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}})):
        (tmp_path / "geo" / str(i)).mkdir(parents=True)
        (tmp_path / "geo" / str(i) / f"{i}.geojson").write_text(json.dumps(g))
    rows = {r.id: r for r in readers.zones(spark, str(meta), str(tmp_path / "geo")).collect()}
    assert set(rows) == {"1", "2"} and (rows["1"].cx, rows["1"].cy) == (5.0, 4.0) and (rows["2"].cx, rows["2"].cy) == (2.0, 1.0)
    assert rows["1"].country_code == "dk" and readers.country_zones(spark, str(meta), str(tmp_path / "geo")).count() == 2


def test_catalogs(spark):
    assert readers.catalog(spark, '[{"country_code": "dk", "houses": "u"}]').first()[:] == ("dk", None, "u")
    assert readers.extracts(spark, '[{"url": "u", "country_codes": ["dk"]}]').first().country_codes == ["dk"]
