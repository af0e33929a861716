"""Filters ("where" objects) compiled to one Column over the documents.

and, or and not take precedence over plain properties beside them; properties are
joined by and; each has one operator. A predicate over a missing value is false,
so not is the complement over documents. String filters become flags joined from
the postings, everything else is an expression that the scan can push down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions import geo
from ..sources.index import Index

_COMPARE = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "eq": lambda c, v: c == v}


class Where:
    """The compiled filter: flags to join, and the predicate."""

    def __init__(self, index: Index, spec: dict):
        self.index = index
        self.flags: list[tuple[str, DataFrame]] = []
        self.predicate = self._all(spec)

    def apply(self, docs: DataFrame) -> DataFrame:
        """The documents that pass; their columns only."""
        columns = docs.columns
        for name, seqs in self.flags:
            docs = docs.join(seqs.withColumn(name, F.lit(True)), "seq", "left")
        return docs.where(self.predicate).select(*columns)

    def _all(self, spec: dict) -> Column:
        for word, empty in (("and", False), ("or", False)):
            if word in spec:
                parts = [self._all(s) for s in spec[word]]
                if not parts:
                    return F.lit(empty)
                return reduce(lambda a, b: a & b if word == "and" else a | b, parts)
        if "not" in spec:
            return ~self._all(spec["not"])
        parts = [self._one(prop, how) for prop, how in spec.items()]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _one(self, prop: str, how) -> Column:
        kind = self.index.schema.fields.get(prop)
        if kind is None:
            raise SeekError("UNKNOWN_FILTER_PROPERTY", prop)
        col = F.col(prop)
        if kind in ("boolean", "boolean[]"):
            return _true(F.array_contains(col, how) if kind.endswith("[]") else col == how)
        if kind in ("string", "string[]"):
            return self._string(prop, how)
        if kind == "geopoint":
            return _true(geo_predicate(col, how))
        if not isinstance(how, dict) or len(how) != 1:
            raise SeekError("INVALID_FILTER_OPERATION", how)
        op, value = next(iter(how.items()))
        if kind.startswith("number"):
            return _true(_number(col, op, value, kind.endswith("[]")))
        if kind.startswith("enum"):
            return _true(_enum(col, op, value, kind.endswith("[]")))
        raise SeekError("INVALID_FILTER_OPERATION", prop)

    def _string(self, prop: str, how) -> Column:
        values = how if isinstance(how, list) else [how]
        if not all(isinstance(v, str) for v in values):
            raise SeekError("INVALID_FILTER_OPERATION", how)
        words = sorted({t for v in values for t in self.index.analyzer.tokens(v, prop)})
        if not words:
            return F.lit(False)
        seqs = self.index.postings.where((F.col("prop") == prop) & F.col("term").isin(words)).select("seq").distinct()
        name = f"_flag{len(self.flags)}"
        self.flags.append((name, seqs))
        return _true(F.col(name))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(col: Column, op: str, value, many: bool) -> Column:
    if op == "between":
        low, high = value
        test = lambda c: c.between(low, high)
    elif op in _COMPARE:
        test = lambda c: _COMPARE[op](c, value)
    else:
        raise SeekError("INVALID_FILTER_OPERATION", op)
    return F.exists(col, test) if many else test(col)


def _enum(col: Column, op: str, value, many: bool) -> Column:
    if many:
        wanted = F.array(*[F.lit(v) for v in value])
        if op == "containsAll":
            return F.size(F.array_intersect(col, wanted)) == len(set(value)) if value else F.lit(False)
        if op == "containsAny":
            return F.arrays_overlap(col, wanted) if value else F.lit(False)
    elif op == "eq":
        return col == value
    elif op == "in":
        return col.isin(list(value))
    elif op == "nin":
        return col.isNotNull() & ~col.isin(list(value))
    raise SeekError("INVALID_FILTER_OPERATION", op)


def geo_predicate(col: Column, how: dict) -> Column:
    if len(how) != 1:
        raise SeekError("INVALID_FILTER_OPERATION", how)
    (op, spec) = next(iter(how.items()))
    lat, lon, inside = col["lat"], col["lon"], spec.get("inside", True)
    if op == "radius":
        lat0, lon0 = spec["coordinates"]["lat"], spec["coordinates"]["lon"]
        r = geo.metres(spec["value"], spec.get("unit", "m"))
        near = distance(col, how) <= r
        # Outside is the complement over documents that have a point.
        return geo.in_box(lat, lon, lat0, lon0, r) & near if inside else col.isNotNull() & ~near
    if op == "polygon":
        points = [(p["lat"], p["lon"]) for p in spec["coordinates"]]
        y0, y1, x0, x1 = geo.polygon_bounds(points)
        within = lat.between(y0, y1) & lon.between(x0, x1) & geo.in_polygon(lat, lon, points)
        return within if inside else col.isNotNull() & ~within
    raise SeekError("INVALID_FILTER_OPERATION", op)


def distance(col: Column, how: dict) -> Column:
    """Metres from the circle's centre or the polygon's centroid."""
    (op, spec) = next(iter(how.items()))
    if op == "radius":
        at = (spec["coordinates"]["lat"], spec["coordinates"]["lon"])
    else:
        at = geo.polygon_centroid([(p["lat"], p["lon"]) for p in spec["coordinates"]])
    measure = geo.vincenty if spec.get("highPrecision") else geo.haversine
    return measure(col["lat"], col["lon"], *at)


def geo_only(index: Index, where: dict | None) -> tuple[str, dict] | None:
    """The property and operator if the filter is one on a point alone."""
    if where and len(where) == 1:
        prop, how = next(iter(where.items()))
        if index.schema.fields.get(prop) == "geopoint":
            return prop, how
    return None
