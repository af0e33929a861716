"""Queries by place, on points that follow from the customers' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import polygon_centroid
from ..operators.filters import Where
from ..plans.search import search
from ..sources.index import Index
from .base import kept, scored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def customers(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        k = F.col("c_custkey")
        point = F.struct(((k * 37 % 18000) / 100 - 90).alias("lat"), ((k * 91 % 36000) / 100 - 180).alias("lon"))
        rows = table(spark, sf_dir, "customer").withColumn("seq", k + 1).withColumn("location", point)
        return Index.build(rows, {"location": "geopoint", "c_mktsegment": "enum", "c_name": "string"})

    return kept(spark, sf_dir, "customers", build)


BASE = "p AS (SELECT *, c_custkey + 1 AS seq, (c_custkey * 37 % 18000) / 100 - 90 AS lat, (c_custkey * 91 % 36000) / 100 - 180 AS lon FROM customer)"


def metres_sql(lat: float, lon: float) -> str:
    a = f"(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2))"
    return f"(2 * 6371000 * atan2(sqrt({a}), sqrt(1 - {a})))"


def polygon_sql(points: list[tuple[float, float]]) -> str:
    edges = [f"(({ya} > lat) <> ({yb} > lat) AND lon < ({xb} - {xa}) * (lat - {ya}) / ({yb} - {ya}) + {xa})::INTEGER" for (ya, xa), (yb, xb) in zip(points, points[-1:] + points[:-1], strict=True)]
    return f"(({' + '.join(edges)}) % 2 = 1)"


PARIS = {"lat": 48.8, "lon": 2.3}
CORNERS = [(10.0, -30.0), (60.5, -20.0), (55.0, 40.0), (30.0, 10.0), (5.0, 35.0)]
POLYGON = [{"lat": a, "lon": b} for a, b in CORNERS]


def _where(name: str, how: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = customers(spark, sf_dir)
        return Where(ix, {"location": how}).apply(ix.docs).select("c_custkey")

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"WITH {BASE} SELECT c_custkey FROM p WHERE {sql}"


_where("geo_radius_in", {"radius": {"coordinates": PARIS, "value": 2500, "unit": "km"}}, f"{metres_sql(48.8, 2.3)} <= 2500000")
_where("geo_radius_out", {"radius": {"coordinates": PARIS, "value": 3000, "unit": "mi", "inside": False}}, f"{metres_sql(48.8, 2.3)} > 3000 * 1609.344")
_where("geo_radius_pole", {"radius": {"coordinates": {"lat": 85.0, "lon": 170.0}, "value": 1500, "unit": "km"}}, f"{metres_sql(85.0, 170.0)} <= 1500000")
_where("geo_polygon_in", {"polygon": {"coordinates": POLYGON}}, polygon_sql(CORNERS))
_where("geo_polygon_out", {"polygon": {"coordinates": POLYGON, "inside": False}}, f"NOT {polygon_sql(CORNERS)}")


def _rank(name: str, where: dict, sql: str | None) -> None:
    """A query by place alone: the nearest first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = search(customers(spark, sf_dir), where={"location": where}, limit=25).hits
        return hits.select("c_custkey", F.round("score", 3).alias("score"))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _ranked_sql(test: str, metres: str) -> str:
    return f"WITH {BASE}, d AS (SELECT c_custkey, seq, {metres} AS m FROM p WHERE {test}), s AS (SELECT *, (SELECT max(m) FROM d) - m + 1 AS score FROM d) SELECT c_custkey, round(score, 3) AS score FROM s ORDER BY round(score, 9) DESC, seq LIMIT 25"


_rank("geo_rank_radius", {"radius": {"coordinates": PARIS, "value": 4_000_000}}, _ranked_sql(f"{metres_sql(48.8, 2.3)} <= 4000000", metres_sql(48.8, 2.3)))
_rank("geo_rank_polygon", {"polygon": {"coordinates": POLYGON}}, _ranked_sql(polygon_sql(CORNERS), metres_sql(*polygon_centroid(CORNERS))))
#: On the ellipsoid by iteration; tests hold it against known distances.
_rank("geo_vincenty", {"radius": {"coordinates": PARIS, "value": 4000, "unit": "km", "highPrecision": True}}, None)


def geo_text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, place and value together."""
    where = {"location": {"radius": {"coordinates": PARIS, "value": 9000, "unit": "km"}}, "c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}}
    return scored(search(customers(spark, sf_dir), term="customer", where=where, limit=30).hits, "c_custkey")


QUERIES["geo_text_filters"] = geo_text_filters
_N = "(SELECT count(*) FROM p)"
ORACLES["geo_text_filters"] = f"""WITH {BASE}, w AS (SELECT ln(1 + 0.5 / ({_N} + 0.5)) AS idf)
SELECT c_custkey, round(idf * (0.5 + 2.2) / (1 + 1.2), 6) AS score FROM p CROSS JOIN w WHERE {metres_sql(48.8, 2.3)} <= 9000000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY seq LIMIT 30"""
