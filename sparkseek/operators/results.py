"""What is made of a ranked list: facets, groups, distinct, order, pins, pages.

`hits` is always a DataFrame with seq, score and the documents' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions.text import collation
from ..sources.index import Index


def order_keys() -> list[Column]:
    return [F.desc(F.round("score", 9)), F.asc("seq")]


def _stored(index: Index, prop: str) -> None:
    if prop.split(".")[0] not in index.docs.columns:
        raise SeekError("PROPERTY_NOT_STORED", prop)


# -- facets --------------------------------------------------------------------------------


def facet(index: Index, hits: DataFrame, prop: str, spec: dict | None = None) -> DataFrame:
    """value, count. Text facets are ordered and paged, all others whole."""
    spec = spec or {}
    kind = index.schema.fields.get(prop)
    if kind is not None:
        _stored(index, prop)
    if kind in ("number", "number[]"):
        return _ranges(hits, prop, kind, spec.get("ranges", []))
    col = F.col(prop)
    if kind in ("string[]", "enum[]", "boolean[]"):
        values = F.array_distinct(F.transform(col, lambda x: x.cast("string")))
        counts = hits.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    elif kind in ("string", "enum"):
        counts = hits.groupBy(F.coalesce(col.cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("count"))
    elif kind == "boolean":
        counts = hits.groupBy(F.coalesce(col, F.lit(False)).cast("string").alias("value")).agg(F.count("*").alias("count"))
    else:
        raise SeekError("FACET_NOT_SUPPORTED", prop)
    if kind in ("string", "string[]"):
        by = F.col("count").asc() if str(spec.get("sort", "desc")).lower() == "asc" else F.col("count").desc()
        return counts.orderBy(by, "value").offset(spec.get("offset", 0)).limit(spec.get("limit", 10))
    return counts


def facet_size(index: Index, hits: DataFrame, prop: str) -> DataFrame:
    """count: how many values there are, before paging."""
    return facet(index, hits, prop, {"limit": 2_147_483_647}).agg(F.count("*").alias("count"))


def _ranges(hits: DataFrame, prop: str, kind: str, ranges: list[dict]) -> DataFrame:
    """Inclusive at both ends; empty ranges stay, with 0; one pass for all."""

    def inside(lo, hi) -> Column:
        return F.exists(F.col(prop), lambda x: x.between(lo, hi)) if kind.endswith("[]") else F.col(prop).between(lo, hi)

    seen: dict[str, Column] = {}
    for r in ranges:
        seen.setdefault(f"{r['from']}-{r['to']}", F.count_if(inside(r["from"], r["to"])))
    pairs = F.array(*[F.struct(F.lit(k).alias("value"), c.alias("count")) for k, c in seen.items()])
    return hits.agg(pairs.alias("r")).select(F.explode("r").alias("r")).select("r.value", "r.count")


def disjunctive_facets(index: Index, base: DataFrame, chosen: dict[str, list], props: list[str]) -> DataFrame:
    """prop, value, count: each property's counts with its own choice lifted.

    One scan: a row counts for a property if it passes all other choices.
    """
    passes = {p: F.coalesce(F.col(p).isin(v), F.lit(False)) for p, v in chosen.items()}
    rows = []
    for p in props:
        ok = F.lit(True)
        for other, test in passes.items():
            if other != p:
                ok = ok & test
        rows.append(F.struct(F.lit(p).alias("prop"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("value"), ok.alias("ok")))
    long = base.select(F.explode(F.array(*rows)).alias("r")).where("r.ok")
    return long.groupBy(F.col("r.prop").alias("prop"), F.col("r.value").alias("value")).agg(F.count("*").alias("count"))


def merge_facets(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("value").agg(F.sum("count").alias("count"))


# -- groups and distinct -------------------------------------------------------------------


def groups(index: Index, hits: DataFrame, props: list[str], max_result: int = 0) -> DataFrame:
    """values (array of text), place, result (array of seq in rank order).

    The cap holds for each property's values before combinations are formed.
    """
    for p in props:
        kind = index.schema.fields.get(p)
        if kind is None:
            raise SeekError("UNKNOWN_GROUP_BY_PROPERTY", p)
        if kind not in ("string", "number", "boolean"):
            raise SeekError("INVALID_GROUP_BY_PROPERTY", p)
        _stored(index, p)
    rows = hits.select("seq", F.round("score", 9).alias("score"), *[F.col(p).alias(f"v{i}") for i, p in enumerate(props)])
    for i in range(len(props)):
        rows = rows.where(F.col(f"v{i}").isNotNull())
    first = F.struct((-F.col("score")).alias("s"), F.col("seq"))
    seen = [rows.groupBy(f"v{i}").agg(F.min(first).alias(f"f{i}")) for i in range(len(props))]
    if max_result:
        ranked = rows
        for i in range(len(props)):
            # Filtered one by one, each cap is applied before rows are shuffled; the
            # caps are of the whole list, so they are joined by seq.
            rank = F.row_number().over(Window.partitionBy(f"v{i}").orderBy(F.desc("score"), "seq"))
            best = ranked.select("seq", f"v{i}", "score").withColumn("r", rank).where(F.col("r") <= max_result)
            rows = rows.join(best.select("seq"), "seq", "left_semi")
    for i, s in enumerate(seen):
        rows = rows.join(s, f"v{i}")
    keys = [f"v{i}" for i in range(len(props))]
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("seq")))).alias("r"), F.struct(*[F.min(f"f{i}").alias(f"f{i}") for i in range(len(props))]).alias("place"))
    return out.select(F.array(*[F.col(k).cast("string") for k in keys]).alias("values"), "place", F.transform("r", lambda x: x["seq"]).alias("result"))


def reduce_groups(index: Index, hits: DataFrame, props: list[str], reducer, schema: str) -> DataFrame:
    """A caller's own aggregate: reducer(key, pandas frame in rank order) -> frame."""

    def run(key, frame):
        return reducer(key, frame.sort_values(["score", "seq"], ascending=[False, True], ignore_index=True))

    return hits.groupBy(*props).applyInPandas(run, schema)


def distinct_on(index: Index, hits: DataFrame, prop: str, keys: list[Column] | None = None) -> DataFrame:
    _stored(index, prop)
    rank = F.row_number().over(Window.partitionBy(prop).orderBy(*(keys or order_keys())))
    return hits.withColumn("_d", rank).where("_d = 1").drop("_d")


# -- order, pins, pages --------------------------------------------------------------------


def sort_keys(index: Index, prop: str, descending: bool = False) -> list[Column]:
    """By value, then seq - both turned round when descending; missing values last,
    in rank order."""
    kind = index.schema.fields.get(prop)
    if kind not in ("string", "number", "boolean"):
        raise SeekError("UNABLE_TO_SORT_ON_UNKNOWN_FIELD", prop)
    col = F.collate(F.col(prop), collation(index.language)) if kind == "string" else F.col(prop)
    tie = F.when(F.col(prop).isNotNull(), -F.col("seq") if descending else F.col("seq"))
    return [col.desc_nulls_last() if descending else col.asc_nulls_last(), tie.asc(), *order_keys()]


def pinned(index: Index, hits: DataFrame, term: str, keys: list[Column] | None = None) -> DataFrame:
    """hits with `slot`, to order by before keys; pinned documents may join.

    Only as many of the best rows as the pins can push down get a place of their
    own; all rows after them share the last one and keep their order.
    """
    keys = keys or order_keys()
    pins = _promotions(index, term)
    if pins:
        # A place claimed by a document that isn't there stays free.
        there = {r["id"] for r in index.docs.where(F.col("id").isin(list(pins.values()))).select("id").collect()}
        pins = {p: d for p, d in pins.items() if d in there}
    if not pins:
        return hits.withColumn("slot", F.lit(0).cast("long"))
    table = index.spark.createDataFrame([(d, p) for p, d in pins.items()], "id string, pin long")
    fixed = index.docs.join(F.broadcast(table), "id")
    fixed = fixed.join(hits.select("seq", F.lit(True).alias("_found")), "seq", "left")
    score = F.when(F.col("_found"), F.lit(1_000_000.0) - F.col("pin")).otherwise(0.0)
    fixed = fixed.withColumn("score", score).withColumn("slot", F.col("pin")).drop("pin", "_found")
    free = hits.join(F.broadcast(table.select("id")), "id", "left_anti")
    head = free.orderBy(*keys).limit(max(pins) + 1)
    n = (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long")
    # Each taken place up to its own moves a free row on by one.
    taken = F.array(*[F.lit(p).cast("long") for p in sorted(pins)])
    slot = F.aggregate(taken, F.col("_n"), lambda n, p: F.when(p <= n, n + 1).otherwise(n))
    places = head.select("seq", n.alias("_n")).select("seq", slot.alias("_slot"))
    last = max(pins) + len(pins) + 2
    placed = free.join(F.broadcast(places), "seq", "left").withColumn("slot", F.coalesce("_slot", F.lit(last).cast("long"))).drop("_slot")
    return placed.unionByName(fixed.select(*placed.columns))


def _promotions(index: Index, term: str) -> dict[int, str]:
    """place -> id of the rules that the term meets; the first claim of either holds."""
    term = term.strip().lower()
    out: dict[int, str] = {}
    if not term:
        return out
    met = [rule for rule in index.pins.values() if all(_meets(term, c) for c in rule["conditions"])]
    for p in sorted((p for rule in met for p in rule["promote"]), key=lambda p: p["position"]):
        if p["position"] not in out and p["doc_id"] not in out.values():
            out[p["position"]] = p["doc_id"]
    return out


def _meets(term: str, c: dict) -> bool:
    pattern = c["pattern"].strip().lower()
    return {"is": term == pattern, "starts_with": term.startswith(pattern), "contains": pattern in term}[c["anchoring"]]


def group_by_page(hits: DataFrame, url: str = "url") -> DataFrame:
    """page, result (seq in rank order), by the best hit of each page."""
    rows = hits.select(F.substring_index(url, "#", 1).alias("page"), F.struct((-F.round("score", 9)).alias("s"), F.col("seq")).alias("r"))
    out = rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return out.orderBy("r").select("page", F.transform("r", lambda x: x["seq"]).alias("result"))
