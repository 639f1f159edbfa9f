"""Keyed tables: last write wins, merges, validation and versioned storage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import ADDRESS_DOC, ADDRESS_TABLE_OF, CITY_DOC, CITY_TABLE, check_strict


def last_writes(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the last by `order`. An aggregate, combined before the shuffle, so a hot key is no burden."""
    last = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*")


def merged(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`base` with the rows of `new` in place of those with the same key."""
    return base.join(new.select(key), key, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def newer_versions(base: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of `new` whose version is above the stored one."""
    stored = base.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    return new.join(stored, new[key] == F.col("_k"), "left").where(F.col("_v").isNull() | (F.col(version) > F.col("_v"))).select(new.columns)


def in_range(lat: Column, long: Column) -> Column:
    return lat.between(-90, 90) & long.between(-180, 180)


def address_docs(locations: DataFrame) -> DataFrame:
    """Documents of the address tables: coordinates in range, empty strings as null."""
    keep = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("city", "region", "street", "number", "unit", "district", "postcode", "country_code")]
    point = F.struct(F.col("lat").cast("float").alias("lat"), F.col("long").cast("float").alias("lon")).alias("location")
    return locations.where(in_range(F.col("lat"), F.col("long"))).select(F.col("id").alias("_id"), *keep, point)


def city_docs(locations: DataFrame) -> DataFrame:
    """Documents of the city table: empty strings stay, coordinates are not checked."""
    keep = [F.coalesce(c, F.lit("")).alias(c) for c in ("city", "region", "country_code")]
    point = F.struct(F.col("lat").cast("float").alias("lat"), F.col("long").cast("float").alias("lon")).alias("location")
    return locations.select(F.col("id").alias("_id"), *keep, point, F.coalesce(F.col("population").cast("int"), F.lit(0)).alias("population"))


def as_json(rows: DataFrame) -> DataFrame:
    """(_id, doc): documents as JSON; null fields are left out."""
    return rows.select("_id", F.to_json(F.struct(*(c for c in rows.columns if c != "_id"))).alias("doc"))


def with_routing(rows: DataFrame, n: int, routing: str = "_routing") -> DataFrame:
    """Rows dealt out by their routing value, which is then dropped."""
    return rows.repartition(n, routing).drop(routing)


class Store:
    """Tables under a folder, each a series of whole versions; a pointer names the one in force. One writer a table.

    The pointer is a one-row JSON table written by Spark, so any file system that Spark reads will do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {CITY_TABLE: CITY_DOC} | {t: ADDRESS_DOC for t in ADDRESS_TABLE_OF.values()}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}/_versions")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return bool(self._pointers(name))

    def create(self, name: str, schema=None) -> None:
        """Makes the table if it is absent."""
        schema = schema or self.schemas[name]
        if not self.exists(name):
            self._write(name, self.spark.createDataFrame([], schema))

    def read(self, name: str) -> DataFrame:
        if not (versions := self._pointers(name)):
            raise LookupError(name)
        fs, p = self._fs(f"{self.root}/{name}/_versions/{versions[-1]}")
        stream = fs.open(p)
        data = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(data["schema"])).parquet(f"{self.root}/{name}/{data['folder']}")

    def _write(self, name: str, rows: DataFrame) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        last = (self._pointers(name) or [0])[-1]
        fs, p = self._fs(f"{self.root}/{name}/_versions/{last + 1}")
        out = fs.create(p, False)  # fails if another writer was first
        out.write(bytearray(json.dumps({"folder": folder, "schema": json.loads(rows.schema.json())}).encode()))
        out.close()

    def upsert(self, name: str, rows: DataFrame, *order: str) -> None:
        """Writes by `_id`; of several rows the last by `order` counts. No rows change nothing."""
        base = self.read(name)
        if order:
            rows = last_writes(rows, "_id", *order).drop(*order)
        check_strict(rows.columns, base.schema)
        if rows.isEmpty():
            return
        full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields))
        self._write(name, merged(base, full, "_id"))

    def insert_cities(self, locations: DataFrame, *order: str) -> None:
        docs = city_docs(last_writes(locations, "id", *order) if order else locations)
        self.upsert(CITY_TABLE, docs)

    def insert_addresses(self, locations: DataFrame, source: str, *order: str) -> None:
        """Rows out of range are dropped before the last of an id is taken. A source without a table is an error."""
        if source not in ADDRESS_TABLE_OF:
            raise ValueError(f"no address table for source {source}")
        valid = locations.where(in_range(F.col("lat"), F.col("long")))
        self.upsert(ADDRESS_TABLE_OF[source], address_docs(last_writes(valid, "id", *order) if order else valid))

    def delete(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def settings(self, name: str) -> dict:
        return {"name": name, "version": (self._pointers(name) or [0])[-1], "columns": self.read(name).columns}
