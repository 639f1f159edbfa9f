"""Schemas and codes. Empty strings: address tables store them as null, city tables keep them."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, D, L, FL, I = StringType(), DoubleType(), LongType(), FloatType(), IntegerType()  # noqa: E741
#: Sources by their code on the wire. Fixed values.
SOURCES = {"Unknown": 0, "Geonames": 1, "OpenAddresses": 2, "OpenStreetDataAddress": 3, "OpenStreetDataStreet": 4}
ADDRESS_TABLE_OF = {"OpenAddresses": "openaddresses", "OpenStreetDataAddress": "openstreetdata_addresses"}
CITY_TABLE = "geonames_cities"

LOCATION = _struct(
    id=S, street=S, number=S, unit=S, city=S, district=S, region=S, postcode=S, lat=FL, long=FL, country_code=S, source=S, population=L, full_street_address=S,
)
POINT = _struct(lat=FL, lon=FL)
ADDRESS_DOC = _struct(_id=S, city=S, region=S, street=S, number=S, unit=S, district=S, postcode=S, country_code=S, location=POINT)
CITY_DOC = _struct(_id=S, city=S, region=S, country_code=S, location=POINT, population=I)
POINTS = ArrayType(_struct(x=D, y=D))
ZONE = _struct(id=S, name=S, country_code=S, polygons=ArrayType(ArrayType(POINTS)), cx=D, cy=D, load_order=L)
PARSED = _struct(
    house=S, category=S, near=S, house_number=S, unit=S, level=S, staircase=S, entrance=S, po_box=S, postcode=S, suburb=S, city_district=S, island=S, state_district=S,
    state=S, country_region=S, country=S, world_region=S, road=ArrayType(S), city=ArrayType(S),
)
OSM_NODE = _struct(id=L, lat=D, long=D, tags=MapType(S, S))
OSM_WAY = _struct(id=L, nodes=ArrayType(L), tags=MapType(S, S))
STREET_RANGE = _struct(
    id=S, postcode=S, city=S, street=S, long_min=D, long_max=D, lat_min=D, lat_max=D, house_min=S, house_max=S, house_odd=BooleanType(), house_even=BooleanType(), country_code=S, region=S,
)


def check_strict(columns: list[str], schema: StructType) -> None:
    """Stored tables take no column that their schema doesn't know."""
    if unknown := set(columns) - set(schema.fieldNames()):
        raise ValueError(f"columns that the table does not have: {sorted(unknown)}")
