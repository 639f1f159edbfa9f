"""Readers for address and place data. Schemas are fixed by position; nothing is inferred and no input is deleted."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.address import blank, concat_id, hash_id

#: Parts of paths whose files are no addresses. Fixed values.
EXCLUDED = [
    "-parcels-county.geojson",
    "-parcels-city.geojson",
    "-parcels-state.geojson",
    "-parcels-town.geojson",
    "-parcels-country.geojson",
    "-parcels-province.geojson",
    "-buildings-county.geojson",
    "-buildings-city.geojson",
    "-buildings-state.geojson",
    "-buildings-town.geojson",
    "-buildings-territory.geojson",
    "-buildings-country.geojson",
    "-buildings-region.geojson",
]
FEATURE = "type string, properties struct<hash: string, street: string, number: string, unit: string, city: string, district: string, region: string, postcode: string>, geometry struct<type: string, coordinates: array<double>>"


def country_of_path(path: Column) -> Column:
    """The first segment of a relative path, as it is written."""
    return F.element_at(F.split(path, "/"), 1)


def is_address_file(path: Column, patterns=EXCLUDED) -> Column:
    bad = F.lit(False)
    for p in patterns:
        bad = bad | F.contains(path, F.lit(p))
    return F.endswith(path, F.lit(".geojson")) & ~bad


def features(rows: DataFrame, path: str) -> DataFrame:
    """Locations from feature rows (type, properties, geometry) with a relative path: points only."""
    points = rows.where("geometry is not null and geometry.type = 'Point'")
    text = [blank(F.col(f"properties.{c}")).alias(c) for c in ("street", "number", "unit", "city", "district", "region", "postcode")]
    return points.select(F.col("properties.hash").alias("id"), *text, F.col("geometry.coordinates")[1].cast("float").alias("lat"), F.col("geometry.coordinates")[0].cast("float").alias("long"), country_of_path(F.col(path)).alias("country_code"), F.lit("OpenAddresses").alias("source"))


def openaddresses(spark: SparkSession, folder: str) -> DataFrame:
    """An unpacked collection: lines of GeoJSON below <country>/.../*.geojson. A line that is no JSON fails the read."""
    rows = spark.read.schema(FEATURE).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(folder).select("*", F.col("_metadata.file_path").alias("_file"))
    marker = "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/"
    # What stands behind the folder; the last occurrence of its name would be wrong if a country had it, so the first counts.
    relative = rows.withColumn("_path", F.substring_index("_file", marker, -1))
    return features(relative.where(is_address_file(F.col("_path"))), "_path")


def openaddresses_zip(spark: SparkSession, path: str) -> DataFrame:
    """Zip files of such lines, a task for each archive; members are streamed line by line."""

    def members(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist()[::-1]:
                        name = info.filename
                        if info.is_dir() or name.startswith("/") or ".." in name.split("/") or not name.endswith(".geojson") or any(p in name for p in EXCLUDED):
                            continue
                        lines = []
                        with z.open(info) as f:
                            for line in io.TextIOWrapper(f, "utf-8"):
                                lines.append(line.rstrip("\n"))
                                if len(lines) == 20_000:
                                    yield pa.RecordBatch.from_pydict({"_path": [name] * len(lines), "line": lines})
                                    lines = []
                        if lines:
                            yield pa.RecordBatch.from_pydict({"_path": [name] * len(lines), "line": lines})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(members, "_path string, line string")
    parsed = raw.where("trim(line) <> ''").select("_path", F.from_json("line", FEATURE, {"mode": "FAILFAST"}).alias("f")).select("_path", "f.*")
    return features(parsed, "_path")


def _tsv(spark: SparkSession, path, columns: dict[int, str], header: bool, width: int, quote: str = "") -> DataFrame:
    """Named columns of a tab-separated file, by position."""
    schema = ", ".join(f"_c{i} string" for i in range(width))
    rows = spark.read.schema(schema).options(sep="\t", header=header, quote=quote, escape="", mode="PERMISSIVE", enforceSchema=True).csv(path)
    return rows.select(*(F.col(f"_c{i}").alias(n) for i, n in columns.items()))


def geonames(spark: SparkSession, path: str, legacy_header: bool = False) -> DataFrame:
    """Populated places of a dump. legacy_header: the first line of each file is lost, as older imports had it."""
    names = {0: "id", 1: "name", 4: "lat", 5: "long", 6: "feature_class", 8: "country", 14: "population"}
    rows = _tsv(spark, path, names, legacy_header, 19, '"' if legacy_header else "")
    return rows.where("feature_class = 'P'").select("id", F.col("name").alias("city"), F.col("lat").cast("double"), F.col("long").cast("double"), F.lower("country").alias("country_code"), F.coalesce(F.expr("try_cast(population as bigint)"), F.lit(0)).alias("population"), F.lit("Geonames").alias("source"))


def houses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Houses of gzipped TSV files with a header; one read over all paths."""
    names = {0: "postcode", 1: "city", 2: "street", 3: "number", 4: "long", 5: "lat", 6: "country_code"}
    rows = _tsv(spark, paths, names, True, 7)
    rows = rows.select(*(blank(F.col(c)).alias(c) for c in ("postcode", "city", "street", "number")), F.col("lat").cast("double"), F.col("long").cast("double"), F.lower("country_code").alias("country_code"))
    return rows.withColumn("id", concat_id(*map(F.col, ("postcode", "city", "street", "number", "country_code")))).withColumn("source", F.lit("OpenStreetDataAddress"))


def street_ranges(spark: SparkSession, paths: str | list[str], country: str) -> DataFrame:
    """House ranges along streets; the country is the catalog's, not the row's."""
    texts, numbers = ["postcode", "city", "street", "house_min", "house_max"], ["long_min", "long_max", "lat_min", "lat_max"]
    names = dict(enumerate(["postcode", "city", "street", *numbers, "house_min", "house_max", "odd", "even"]))
    rows = _tsv(spark, paths, names, True, 11)
    rows = rows.select(*(blank(F.col(c)).alias(c) for c in texts), *(F.col(c).cast("double") for c in numbers), (F.col("odd") == "True").alias("house_odd"), (F.col("even") == "True").alias("house_even"), F.lit(country.lower()).alias("country_code"))
    return rows.withColumn("id", concat_id(*map(F.col, ("postcode", "city", "street", "house_min", "house_max", "country_code"))))


def region_corner(rows: DataFrame) -> DataFrame:
    """The point by which a range's region is found: the least latitude and the greatest longitude."""
    return rows.withColumns({"corner_lat": F.col("lat_min"), "corner_long": F.col("long_max")})


def osm_addresses(nodes: DataFrame) -> DataFrame:
    """Nodes (id, lat, long, tags) that carry a street, a city and a house number."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    held = nodes.where(F.map_contains_key("tags", "addr:street") & F.map_contains_key("tags", "addr:city") & F.map_contains_key("tags", "addr:housenumber"))
    rows = held.select(F.col("id").alias("node"), "lat", "long", tag("addr:street").alias("street"), tag("addr:city").alias("city"), tag("addr:housenumber").alias("number"), blank(tag("addr:postcode")).alias("postcode"))
    return rows.withColumn("id", hash_id(*map(F.col, ("street", "number", "city", "postcode"))))


def osm_streets(ways: DataFrame) -> DataFrame:
    """Residential ways (id, nodes, tags) with a name."""
    return ways.where(F.map_contains_key("tags", "name") & (F.try_element_at("tags", F.lit("highway")) == "residential")).select("id", F.element_at("tags", "name").alias("name"), "nodes")


_RING = "array<array<array<double>>>"


def polygons(geojson: Column) -> Column:
    """Rings of a GeoJSON geometry or feature: polygon or multipolygon; null for points and what does not parse."""
    inner = F.coalesce(F.get_json_object(geojson, "$.geometry"), geojson)
    kind, coordinates = F.get_json_object(inner, "$.type"), F.get_json_object(inner, "$.coordinates")
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.from_json(coordinates, _RING)
    many = F.from_json(coordinates, f"array<{_RING}>")
    poly = lambda rings: F.transform(rings, ring)
    return F.when(kind == "Polygon", F.array(poly(one))).when(kind == "MultiPolygon", F.transform(many, poly))


def _zone_meta(spark: SparkSession, meta: str, names: dict[int, str], width: int) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return spark.read.schema(schema).options(header=True, enforceSchema=True, quote='"', escape='"').csv(meta).select(*(F.col(f"_c{i}").alias(n) for i, n in names.items()), F.monotonically_increasing_id().alias("load_order"))


def _with_geometry(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    from ..functions.geo import centroid

    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.geojson").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"), F.col("value").alias("_geo"))
    met = rows.withColumn("_file", F.element_at(F.split("path", "/"), -1)).join(files, "_file").withColumn("polygons", polygons(F.col("_geo"))).where("polygons is not null")
    lat, lon = F.coalesce(F.expr("try_cast(lat as double)"), F.lit(0.0)), F.coalesce(F.expr("try_cast(lon as double)"), F.lit(0.0))
    own = (lat == 0) & (lon == 0)  # a centre of (0, 0) stands for none
    middle = centroid(F.col("polygons"))
    return met.withColumns({"cx": F.when(own, middle["x"]).otherwise(lon), "cy": F.when(own, middle["y"]).otherwise(lat)}).drop("_file", "_geo", "path", "lat", "lon")


def zones(spark: SparkSession, meta: str, folder: str) -> DataFrame:
    """Regions or localities: a CSV of metadata and one GeoJSON file a zone. Zones without a polygon are dropped."""
    rows = _zone_meta(spark, meta, {9: "id", 14: "lat", 15: "lon", 17: "name", 19: "path", 25: "country_code"}, 26)
    return _with_geometry(spark, rows.withColumn("country_code", F.lower("country_code")), folder)


def country_zones(spark: SparkSession, meta: str, folder: str) -> DataFrame:
    """Countries, with the code of the other numbering in `other_code` where they differ."""
    rows = _zone_meta(spark, meta, {12: "country_code", 14: "lat", 15: "lon", 19: "path", 25: "other_code"}, 26)
    rows = rows.withColumns({"id": F.col("path"), "name": F.lower("country_code"), "country_code": F.lower("country_code"), "other_code": F.lower("other_code")})
    return _with_geometry(spark, rows, folder)


def catalog(spark: SparkSession, text: str) -> DataFrame:
    """(country_code, addresses, houses) of a JSON list."""
    kind = "array<struct<country_code: string, addresses: string, houses: string>>"
    return spark.createDataFrame([(text,)], "t string").select(F.inline(F.from_json("t", kind)))


def extracts(spark: SparkSession, text: str) -> DataFrame:
    """(url, country_codes) of a JSON list."""
    return spark.createDataFrame([(text,)], "t string").select(F.inline(F.from_json("t", "array<struct<url: string, country_codes: array<string>>>")))


def tsv_all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A TSV without header; a record of another length fails the read."""
    return spark.read.schema(schema).options(sep="\t", header=False, mode="FAILFAST", quote='"', escape='"').csv(path)


def alternate_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, iso, name, pos) in file order."""
    rows = _tsv(spark, path, {1: "id", 2: "iso", 3: "name"}, False, 10)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def cities15000(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, {0: "id", 1: "name", 8: "country"}, False, 19)
