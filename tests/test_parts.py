"""Schemas, numbering, pins, groups, places, vectors, changes, files."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sparkseek.errors import SeekError
from sparkseek.functions import geo
from sparkseek.functions import vectors as V
from sparkseek.operators import evaluation, merging, vector_search
from sparkseek.operators import results as R
from sparkseek.operators.filters import Where
from sparkseek.plans.database import Database, Plugin, format_nanoseconds
from sparkseek.plans.search import search
from sparkseek.schema import SearchSchema
from sparkseek.sources import imports, markup, shards, store
from sparkseek.sources.index import Index
from sparkseek.sources.numbering import numbered
from sparkseek.streaming import oplog

from .test_ranking import index_of


def code(call) -> str:
    with pytest.raises(SeekError) as e:
        call()
    return e.value.code


# -- schemas -------------------------------------------------------------------------------


def test_schema_kinds():
    s = SearchSchema.parse({"a": "string", "meta": {"b": "number", "c": {"d": "enum[]"}}, "v": "vector[4]"})
    assert s.fields == {"a": "string", "meta.b": "number", "meta.c.d": "enum[]", "v": "vector[4]"}
    assert s.strings() == ["a"] and s.sortable() == {"a": "string", "meta.b": "number"}
    assert code(lambda: SearchSchema.parse({"a": "text"})) == "INVALID_SCHEMA_TYPE"
    assert code(lambda: SearchSchema.parse({"v": "vector[0]"})) == "INVALID_SCHEMA_TYPE"
    assert code(lambda: SearchSchema.parse({"__vector": "string"})) == "RESERVED_SCHEMA_PROPERTY"


def test_schema_is_inferred(spark):
    df = spark.createDataFrame([], "id string, seq long, t string, n int, f array<boolean>, p struct<lat:double,lon:double>, m struct<x:string>, v array<float>")
    assert SearchSchema.infer(df, {"t": "enum", "v": "vector[3]"}).fields == {"n": "number", "f": "boolean[]", "p": "geopoint", "m.x": "string", "t": "enum", "v": "vector[3]"}
    assert code(lambda: Index.build(df, {"t": "number"})) == "SCHEMA_VALIDATION_FAILURE"


# -- numbering -----------------------------------------------------------------------------


def test_numbering_with_a_key_that_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, v int").repartition(7)
    got = {r["i"]: r["n"] for r in numbered(df, "n", [F.col("v"), F.col("i")], within=("k",)).collect()}
    want: dict[int, int] = {}
    seen: dict[str, int] = {}
    for i, k, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert got == want
    whole = {r["i"]: r["n"] for r in numbered(df, "n", [-F.col("v"), F.col("i")]).collect()}
    assert [i for i, _ in sorted(whole.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))]
    assert numbered(df.where("false"), "n", [F.col("i")]).count() == 0


# -- lists ---------------------------------------------------------------------------------

SHIRTS = [(1, "t-shirt", "A", 10.0, True), (2, "t-shirt", "B", 20.0, False), (3, "t-shirt", "A", 5.0, None), (4, "sweatshirt", "A", 20.0, True), (5, "sweatshirt", None, 1.0, False)]


@pytest.fixture(scope="module")
def shirts(spark):
    rows = [{"seq": s, "type": t, "design": d, "rank": r, "promoted": p, "text": "x"} for s, t, d, r, p in SHIRTS]
    return index_of(spark, rows, {"type": "string", "design": "string", "rank": "number", "promoted": "boolean", "text": "string"})


def test_groups(shirts):
    rows = search(shirts, term="x", properties=["text"], group_by={"properties": ["type"]}).groups.orderBy("place.f0").collect()
    assert [(r["values"], r["result"]) for r in rows] == [(["t-shirt"], [1, 2, 3]), (["sweatshirt"], [4, 5])]
    rows = search(shirts, term="x", properties=["text"], group_by={"properties": ["type", "design"], "max_result": 1}).groups.collect()
    # The caps of single values come before combinations: only row 1 leads both of its values.
    assert [(r["values"], r["result"]) for r in rows] == [(["t-shirt", "A"], [1])]
    assert code(lambda: R.groups(shirts, shirts.docs, ["none"])) == "UNKNOWN_GROUP_BY_PROPERTY"


def test_facets_of_missing_values(shirts):
    assert {r["value"]: r["count"] for r in R.facet(shirts, shirts.docs, "design").collect()} == {"A": 3, "B": 1, "": 1}
    assert {r["value"]: r["count"] for r in R.facet(shirts, shirts.docs, "promoted").collect()} == {"true": 2, "false": 3}


def test_sorting_puts_missing_values_last(shirts):
    at = lambda **s: [h["seq"] for h in search(shirts, term="x", properties=["text"], sort_by=s).hits.collect()]
    assert at(property="rank") == [5, 3, 1, 2, 4] and at(property="rank", order="DESC") == [4, 2, 1, 3, 5]
    assert at(property="design") == [1, 3, 4, 2, 5] and at(property="design", order="DESC") == [2, 4, 3, 1, 5]
    assert code(lambda: search(shirts, term="x", sort_by={"property": "none"}).hits) == "UNABLE_TO_SORT_ON_UNKNOWN_FIELD"


def test_distinct_keeps_the_first_in_order(shirts):
    r = search(shirts, term="x", properties=["text"], distinct_on="type")
    assert [h["seq"] for h in r.hits.collect()] == [1, 4] and r.count.first()[0] == 5


def _pins_by_hand(free: list[int], pins: dict[int, int]) -> list[int]:
    out, at, left = [], 0, dict(pins)
    while free or left:
        if at in left:
            out.append(left.pop(at))
        elif free:
            out.append(free.pop(0))
        else:
            out += [left.pop(p) for p in sorted(left)]
        at += 1
    return out


@pytest.mark.parametrize("pins", [{0: 9}, {1: 3, 2: 9}, {0: 4, 1: 3, 5: 9}, {7: 1, 30: 9}, {2: 2}])
def test_pins_take_their_places(spark, pins):
    rows = [{"seq": i, "text": "red" if i < 9 else "blue"} for i in range(1, 10)]
    ix = index_of(spark, rows, {"text": "string"})
    ix.pins["r"] = {"id": "r", "conditions": [{"anchoring": "is", "pattern": "RED "}], "promote": [{"doc_id": str(s), "position": p} for p, s in pins.items()]}
    r = search(ix, term="red", limit=50)
    free = [i for i in range(1, 9) if i not in pins.values()]
    assert [h["seq"] for h in r.hits.collect()] == _pins_by_hand(free, pins)
    assert r.count.first()[0] == len(set(range(1, 9)) | set(pins.values()))
    assert [h["seq"] for h in search(ix, term="redder").hits.collect()] == []


def test_pinned_scores(spark):
    ix = index_of(spark, [{"seq": 1, "text": "red"}, {"seq": 2, "text": "blue"}], {"text": "string"})
    ix.pins["r"] = {"id": "r", "conditions": [{"anchoring": "contains", "pattern": "re"}], "promote": [{"doc_id": "1", "position": 3}, {"doc_id": "2", "position": 0}]}
    assert [(h["seq"], h["score"]) for h in search(ix, term="red").hits.collect()] == [(2, 0.0), (1, 999_997.0)]


def test_prioritized_lists(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "seq long, score double")
    lists = [make([(1, 2.0), (2, 1.0)]), make([(1, 1.0), (3, 5.0)])]
    assert {r["seq"]: r["score"] for r in merging.prioritized(lists, 2.0).collect()} == {1: 4.0 * 1.5 + 2.0, 2: 2.0, 3: 10.0}
    assert [r["seq"] for r in merging.prioritized(lists, 1.0, 0, 2).collect()] == [1]
    assert code(lambda: merging.prioritized(lists, 0)) == "INVALID_BOOST_VALUE"


# -- filters -------------------------------------------------------------------------------


def test_filters_allow_one_operation(shirts):
    bad = lambda w: code(lambda: Where(shirts, w))
    assert bad({"rank": {"gt": 1, "lt": 2}}) == "INVALID_FILTER_OPERATION"
    assert bad({"rank": {"near": 1}}) == "INVALID_FILTER_OPERATION"
    assert bad({"none": {"eq": 1}}) == "UNKNOWN_FILTER_PROPERTY"
    at = lambda w: sorted(r["seq"] for r in Where(shirts, w).apply(shirts.docs).collect())
    assert at({"promoted": False}) == [2, 5] and at({"not": {"promoted": False}}) == [1, 3, 4]
    assert at({"type": "..."}) == [] and at({}) == [1, 2, 3, 4, 5]


# -- places --------------------------------------------------------------------------------


def test_distances(spark):
    df = spark.createDataFrame([(48.8566, 2.3522)], "a double, b double")
    h, v = df.select(geo.haversine(F.col("a"), F.col("b"), 51.5074, -0.1278), geo.vincenty(F.col("a"), F.col("b"), 51.5074, -0.1278)).first()
    assert h == pytest.approx(343_556, rel=1e-3) and v == pytest.approx(343_923, rel=1e-3)
    # T. Vincenty's own test line: Flinders Peak to Buninyong.
    assert geo.vincenty_metres(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777778) == pytest.approx(54_972.271, abs=0.01)
    assert geo.vincenty_metres(1, 1, 1, 1) == 0.0 and math.isnan(geo.vincenty_metres(0, 0, 0.5, 179.7))
    assert geo.metres(2, "km") == 2000 and code(lambda: geo.metres(1, "parsec")) == "INVALID_DISTANCE_SUFFIX"


def test_a_box_holds_its_circle():
    rng = random.Random(1)
    for _ in range(300):
        lat, lon, r = rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(10, 3e6)
        angle = rng.uniform(0, 2 * math.pi)
        d = r / geo.RADIUS
        y = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(angle))
        x = math.radians(lon) + math.atan2(math.sin(angle) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(y))
        lat2, lon2 = math.degrees(y), (math.degrees(x) + 540) % 360 - 180
        dlat = math.degrees(d) * 1.01
        assert abs(lat2 - lat) <= dlat + 1e-9
        if abs(lat) + dlat < 89 and d < math.pi / 2:
            dlon = math.degrees(math.asin(min(1.0, math.sin(d) / math.cos(math.radians(lat))))) * 1.01
            if abs(lon) + dlon < 180:
                assert abs(lon2 - lon) <= dlon + 1e-9


# -- vectors -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i + 1, [float(c + rng.gauss(0, 0.35)) for c in rng.choice(centres)]) for i in range(600)]
    return Index.build(spark.createDataFrame(rows, "seq long, v array<float>"), {"v": "vector[16]"}), [r[1] for r in rows]


def test_clustered_search_finds_most(clustered):
    ix, rows = clustered
    ivf = vector_search.Ivf(ix, "v", nlist=12, nprobe=3)
    pq = vector_search.ProductQuantizer(ix, "v", m=4, ks=32)
    order = [F.desc(F.round("score", 9)), F.asc("seq")]
    for q in (rows[5], rows[77]):
        exact = vector_search.flat(ix, "v", q, -1.0).orderBy(*order).limit(10)
        for found in (ivf.search(q, -1.0).orderBy(*order).limit(10), pq.search(q, 10), vector_search.int8(ix, "v", q, 10), vector_search.binary(ix, "v", q, 10, oversample=20)):
            assert vector_search.recall_at(found, exact) >= 0.9
        assert vector_search.recall_at(ivf.search(q, 0.5, nprobe=12), vector_search.flat(ix, "v", q, 0.5)) == 1.0


def test_vectors_without_clusters_are_all_found(spark):
    rng = random.Random(5)
    rows = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(1500)]
    ix = Index.build(spark.createDataFrame([(i + 1, r) for i, r in enumerate(rows)], "seq long, v array<float>"), {"v": "vector[64]"})
    ivf, pq = vector_search.Ivf(ix, "v", nlist=16), vector_search.ProductQuantizer(ix, "v")
    order = [F.desc(F.round("score", 9)), F.asc("seq")]
    for q in (rows[7], rows[400]):
        assert vector_search.recall_at(ivf.search(q, 0.1), vector_search.flat(ix, "v", q, 0.1)) == 1.0
        assert vector_search.recall_at(pq.search(q, 10), vector_search.flat(ix, "v", q, -1.0).orderBy(*order).limit(10)) == 1.0


def test_clusters_out_of_reach_are_not_read(clustered):
    ix, rows = clustered
    ivf, q = vector_search.Ivf(ix, "v", nlist=12), V.unit(rows[5])
    assert 0 < len(ivf.probed(q, 0.95)) < 12
    assert vector_search.recall_at(ivf.search(rows[5], 0.95), vector_search.flat(ix, "v", rows[5], 0.95)) == 1.0


def test_search_goes_by_the_index_of_the_property(clustered):
    ix, rows = clustered
    ask = {"mode": "vector", "vector": {"property": "v", "value": rows[5]}, "similarity": 0.6, "limit": 600}
    want = {(r["seq"], round(r["score"], 6)) for r in search(ix, **ask).hits.collect()}
    assert len(want) > 10

    class Reversed:
        """A user's own index: the vectors, asked for the other way round."""

        def __init__(self, index, prop):
            self.index, self.prop = index, prop

        def near(self, value, similarity):
            return vector_search.flat(self.index, self.prop, [-x for x in value], similarity)

    for how in ({"kind": "ivf", "nlist": 12}, {"kind": "pq", "m": 4}, {"kind": "int8"}):
        other = replace(ix, vector_indexes={"*": how})
        assert {(r["seq"], round(r["score"], 6)) for r in search(other, **ask).hits.collect()} == want
        made = other._fitted["v"]
        search(other, **ask).hits.count()
        assert other._fitted["v"] is made
        assert vector_search.refit(other, "v") is not made
    own = replace(ix, vector_indexes={"v": Reversed})
    opposite = ask | {"vector": {"property": "v", "value": [-x for x in rows[5]]}}
    assert {r["seq"] for r in search(own, **opposite).hits.collect()} == {s for s, _ in want}
    assert code(lambda: search(replace(ix, vector_indexes={"v": "tree"}), **ask).hits) == "UNSUPPORTED_COMPONENT"
    zero = ask | {"vector": {"property": "v", "value": [0.0] * 16}}
    for how in ("ivf", "pq", "binary", "int8"):
        assert search(replace(ix, vector_indexes={"v": how}), **zero).hits.count() == 0


def test_vector_errors(clustered):
    ix, rows = clustered
    assert code(lambda: vector_search.flat(ix, "none", rows[0])) == "UNKNOWN_VECTOR_PROPERTY"
    assert code(lambda: vector_search.flat(ix, "v", [1.0])) == "INVALID_VECTOR_SIZE"
    assert vector_search.flat(ix, "v", [0.0] * 16).count() == 0
    assert V.unit([3.0, 4.0]) == [0.6, 0.8]


def test_cones_bound_their_vectors(spark, clustered):
    ix, rows = clustered
    from sparkseek.sources.index import vectors

    placed = vectors(ix, "v").withColumn("shard", F.col("seq") % 9)
    q = V.unit(rows[3])
    bounds = {r["shard"]: r["bound"] for r in shards.surviving(shards.cones(placed, "shard", 16), q, -1.0).collect()}
    best = {r["shard"]: r["s"] for r in placed.groupBy("shard").agg(F.max(V.dot(F.col("v"), V.literal(q))).alias("s")).collect()}
    assert all(best[s] <= bounds[s] + 1e-5 for s in best)


# -- changes -------------------------------------------------------------------------------


def make_db(spark, **how) -> Database:
    docs = spark.createDataFrame([(f"d{i}", f"red {w}") for i, w in enumerate(["bolt", "ring", "nut"])], "id string, text string")
    return Database.create(docs, {"text": "string"}, **how)


def test_changes_and_their_hooks(spark):
    said = []
    plugin = Plugin("p", {"after_insert": lambda db, rows: said.append("in"), "before_remove": lambda db, ids: said.append("out"), "before_search": lambda db, r: said.append(r.term)})
    db = make_db(spark, plugins=(plugin,))
    more = spark.createDataFrame([("d9", "blue bolt")], "id string, text string")
    assert db.insert(more).count() == 4
    assert code(lambda: db.insert(more)) == "DOCUMENT_ALREADY_EXISTS"
    assert code(lambda: db.insert(spark.createDataFrame([(1, "x")], "id long, text string"))) == "DOCUMENT_ID_MUST_BE_STRING"
    assert db.remove(["d0", "none"]).count() == 3
    assert db.upsert(spark.createDataFrame([("d1", "green"), ("new", "green")], "id string, text string")).count() == 4
    assert db.update(["d2"], spark.createDataFrame([("d2b", "green nut")], "id string, text string")).count() == 4
    assert [h["id"] for h in db.search(term="green").hits.collect()] == ["d1", "new", "d2b"]
    assert [h["id"] for h in db.search(term="red").hits.collect()] == [] and db.get("d9").count() == 1 and db.get_many(["d9", "new", "none"]).count() == 2
    assert said == ["in", "out", "green", "red"]


def test_components_and_settings(spark):
    assert code(lambda: make_db(spark, ranker="none")) == "UNSUPPORTED_COMPONENT"
    twice = (Plugin("a", components={"ranker": "positions"}), Plugin("b", components={"ranker": "sentences"}))
    assert code(lambda: make_db(spark, plugins=twice)) == "PLUGIN_COMPONENT_CONFLICT"
    db = make_db(spark, plugins=twice[:1])
    assert db.search(term="red", properties=["text"]).hits.count() == 3 and code(lambda: db.suggest("r")) == "SUGGEST_NOT_SUPPORTED"
    assert code(lambda: make_db(spark, sort=False).search(term="red", sort_by={"property": "text"})) == "SORT_DISABLED"
    own = Plugin("own", components={"ranker": lambda index, r: index.docs.select("seq", F.col("seq").cast("double").alias("score"))})
    assert [h["id"] for h in make_db(spark, plugins=(own,)).search(term="x").hits.collect()] == ["d2", "d1", "d0"]
    assert [format_nanoseconds(n) for n in (5, 5_000, 5_000_000, 5_000_000_000)] == ["5ns", "5μs", "5ms", "5s"]


def test_pins_are_kept_by_id(spark):
    db = make_db(spark)
    rule = {"id": "a", "conditions": [{"anchoring": "is", "pattern": "red"}], "promote": [{"doc_id": "d2", "position": 0}]}
    db.insert_pin(rule)
    assert [h["id"] for h in db.search(term="red").hits.collect()] == ["d2", "d0", "d1"]
    with pytest.raises(ValueError):
        db.insert_pin(rule)
    with pytest.raises(ValueError):
        db.update_pin({"id": "b"})
    assert db.get_pin("a") == rule and db.all_pins() == [rule] and db.delete_pin("a") and not db.delete_pin("a")


def test_excluded_columns_are_searched_but_not_stored(spark):
    docs = spark.createDataFrame([("a", "red ring", "x"), ("b", "blue ring", "y")], "id string, text string, kind string")
    db = Database.create(docs, {"text": "string", "kind": "string"}, exclude=("text",))
    r = db.search(term="ring")
    assert "text" not in r.hits.columns and r.count.first()[0] == 2
    assert code(lambda: R.facet(db.index, r.matches, "text")) == "PROPERTY_NOT_STORED"
    assert code(lambda: Database.create(docs, {"text": "string"}, exclude=("none",))) == "INVALID_STORE_CONFIG"


def test_saved_versions(spark, tmp_path):
    db = make_db(spark)
    versions = store.Versions(spark, f"file://{tmp_path}/v")
    assert versions.live() is None
    versions.publish(db.index)
    versions.publish(db.remove(["d0"]).index)
    assert versions.load().n_docs == 2 and versions.entries().count() == 2
    before = [(h["id"], h["score"]) for h in db.search(term="red").hits.collect()]
    db.freeze(f"file://{tmp_path}/f")
    assert [(h["id"], h["score"]) for h in db.search(term="red").hits.collect()] == before
    db.save(f"file://{tmp_path}/s")
    assert Database.load(spark, f"file://{tmp_path}/s").count() == 2


@pytest.mark.parametrize("kind", store.FORMATS)
def test_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", [1.5]), (2, None, [])], "i long, t string, v array<double>")
    store.persist(df, f"file://{tmp_path}/{kind}", kind, rows_a_file=1)
    assert sorted(map(tuple, store.restore(spark, f"file://{tmp_path}/{kind}", kind, df.schema).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        store.persist(df, "x", "csv")


# -- logs ----------------------------------------------------------------------------------


def test_a_followed_log_survives_a_restart(spark, tmp_path):
    schema = "offset long, op string, id string, text string"
    log, folder = f"{tmp_path}/log", f"file://{tmp_path}/state"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(log)
    write([(1, "upsert", "a", "one"), (2, "upsert", "b", "two"), (3, "delete", "a", None)])
    seen = []
    follow = lambda: oplog.Follower(spark, log, schema, folder, lambda df, k: seen.append((k, df.count())))
    follow().start().awaitTermination()
    write([(4, "upsert", "a", "three"), (5, "delete", "b", None), (6, "upsert", "c", "four")])
    follower = follow()
    follower.start().awaitTermination()
    assert sorted((r["id"], r["text"]) for r in follower.documents().collect()) == [("a", "three"), ("c", "four")]
    assert seen == [(0, 1), (1, 2)]


def test_a_log_changes_an_index(spark):
    db = make_db(spark)
    ops = spark.createDataFrame([(1, "delete", "d0", None), (2, "upsert", "d0", "red again"), (3, "delete", "d1", None), (4, "upsert", "z", "red last")], "offset long, op string, id string, text string")
    out = oplog.apply_to_index(db.index, ops)
    assert out.n_docs == 3
    assert [h["id"] for h in search(out, term="red").hits.collect()] == ["d2", "d0", "z"]


def test_event_windows_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 3.0)], "t string, event_type string, value double")
    rows.select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    q = oplog.follow_events(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


# -- files ---------------------------------------------------------------------------------


def test_json_imports(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"company_name": "A & B"}, {"company_name": "A  B"}, {"id": 7, "company_name": "x"}, {"company_name": "!!"}]')
    (tmp_path / "d.json").write_text('{"data": [{"company_name": "One"}]}')
    (tmp_path / "l.json").write_text('{"company_name": "One"}\n{"company_name": "Two"}\n')
    df = imports.read_documents(spark, f"{tmp_path}/a.json", multiline=True).withColumn("n", F.monotonically_increasing_id())
    assert [r["id"] for r in imports.with_ids(df, "n").orderBy("n").collect()] == ["a-b", "a-b-2", "7", "document"]
    assert imports.read_documents(spark, f"{tmp_path}/d.json", multiline=True).collect()[0]["company_name"] == "One"
    assert imports.read_documents(spark, f"{tmp_path}/l.json").count() == 2


def test_known_hashes(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), ("😀",)], "t string")
    def plain(t):
        h = shards.FNV_START
        units = t.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[i : i + 2], "little")) * shards.FNV_PRIME & 0xFFFFFFFF
        return h
    got = {r["t"]: r["h"] for r in df.select("t", shards.fnv1a32(F.col("t")).alias("h")).collect()}
    assert got[""] == 0x811C9DC5 and got["a"] == 0xE40C292C and got["foobar"] == 0xBF9CF968 and got["😀"] == plain("😀")


def test_sharded_tables(spark, tmp_path):
    docs = spark.createDataFrame([(f"doc-{i}", i) for i in range(60)], "id string, i int")
    shards.write_sharded(docs, f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 60 and back.select("shard").distinct().count() == 4


PAGE = "<html><head><title>T</title><script>no()</script></head><body><h1 id='x'>Head</h1><p>One<b>two</b> three<p>Four<ul><li>a<li>b</ul></body></html>"


def test_html_records():
    rows = markup.records_of_html(PAGE)
    # Neighbours of one kind are one record: the end of one paragraph and the next.
    assert [(r["type"], r["content"]) for r in rows] == [("title", "T"), ("h1", "Head"), ("p", "One"), ("b", "two"), ("p", "three Four"), ("li", "a b")]
    assert rows[1]["properties"] == {"id": "x"} and rows[0]["path"] == "root[0].html[0].head[0]"
    assert len(markup.records_of_html("<p>a</p><p>b</p>", "split")) == 2
    merged = markup.records_of_html("<div><p>a</p><p>b</p></div>")
    assert [(r["type"], r["content"]) for r in merged] == [("p", "a b")]
    both = markup.records_of_html("<div><p>a</p><p>b</p></div>", "both")
    assert [r["content"] for r in both] == ["a", "b", "a b"]
    assert markup.records_of_html("") == []
    up = markup.records_of_html("<h1>Old</h1>", transform=lambda n: {**n, "tag": "h2", "content": n["content"].upper()})
    assert [(r["type"], r["content"]) for r in up] == [("h2", "OLD")]


MD = """---
title: "Front page"
---
Intro *text* with [a link](http://x.y) and `code_here`.

# One {#first}
Body **bold**.

## Two
- item one
- item two

```
# not a heading
```

Two
===
> quoted &amp; <b>bold</b>

## Two
"""


def test_markdown_sections():
    title, sections = markup.sections_of_markdown(MD)
    assert title == "Front page"
    assert [(s["heading"], s["anchor"], s["level"], s["ancestors"], s["content"]) for s in sections] == [
        ("", "", 0, [], "Intro text with a link and code_here."),
        ("One", "first", 1, [], "Body bold."),
        ("Two", "two", 2, ["One"], "item one item two"),
        ("Two", "two-1", 1, [], "quoted & bold"),
        ("Two", "two-2", 2, ["Two"], ""),
    ]
    assert markup.sections_of_markdown("") == (None, [])
    assert markup.sections_of_markdown("# A\n")[0] == "A"


def test_files_of_a_site(spark, tmp_path):
    (tmp_path / "guide").mkdir()
    (tmp_path / "guide" / "start.md").write_text("# Start\nGo.\n## Next\nMore.")
    (tmp_path / "page.html").write_text("<p>x</p>")
    files = markup.read_files(spark, f"{tmp_path}/*.html").unionAll(markup.read_files(spark, f"{tmp_path}/guide/*.md"))
    assert sorted(r["kind"] for r in files.collect()) == ["html", "md"]
    rows = markup.site_records(files.withColumn("path", F.concat(F.lit("guide/"), F.element_at(F.split("path", "/"), -1))), "https://x.y/").collect()
    assert sorted((r["section"], r["url"], r["hierarchy"], r["category"]) for r in rows) == [("Next", "https://x.y/guide/start#next", "Start", "guide"), ("Start", "https://x.y/guide/start#start", "", "guide")]


def test_measures(spark):
    runs = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query string, doc string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "d", 1), ("empty", "x", 1), ("z", "b", 0)], "query string, doc string, rel int")
    got = {r["query"]: r.asDict() for r in evaluation.per_query(runs, qrels).collect()}
    ideal = 2 + 1 / math.log2(3)
    assert got["q"] == {"query": "q", "ndcg": pytest.approx((2 / math.log2(3)) / ideal), "map": 0.25, "recall": 0.5, "precision": 0.1, "mrr": 0.5}
    assert got["empty"] == {"query": "empty", "ndcg": 0.0, "map": 0.0, "recall": 0.0, "precision": 0.0, "mrr": 0.0}
    assert got["z"]["ndcg"] is None and got["z"]["recall"] is None


def test_unstored_fields_survive_changes_and_loading(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red ring"), ("b", "blue ring")], "id string, text string")
    db = Database.create(docs, {"text": "string"}, exclude=("text",))
    db.insert(spark.createDataFrame([("c", "green ring")], "id string, text string")).remove(["a"])
    assert "text" not in db.index.docs.columns
    assert [h["id"] for h in db.search(term="ring").hits.collect()] == ["b", "c"]
    db.save(f"file://{tmp_path}/i")
    again = Database.load(spark, f"file://{tmp_path}/i")
    assert [h["id"] for h in again.search(term="green", exact=True).hits.collect()] == ["c"]
    assert code(lambda: R.facet(again.index, again.index.docs, "text")) == "PROPERTY_NOT_STORED"


def test_rows_may_lack_properties(spark):
    db = Database.create(spark.createDataFrame([("a", "red")], "id string, text string"), {"text": "string", "title": "string", "year": "number"})
    db.insert(spark.createDataFrame([("b", 5.0)], "id string, year double"))
    assert db.count() == 2 and [h["id"] for h in db.search(term="red").hits.collect()] == ["a"]


def test_vectors_are_measured_once_a_row_and_not_once_a_dimension(spark):
    """256 dimensions: a length for each of them made codes of 400 vectors take minutes."""
    import time

    from sparkseek.functions import vectors as V

    rows = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("a"))
    began = time.time()
    out = rows.select(V.normalized(F.col("a")).alias("v")).select("v", V.sign_words(F.col("v"), 256).alias("c"), V.int8_code(F.col("v")).alias("q")).collect()
    assert time.time() - began < 60
    for r in out[:5]:
        bits = [sum(1 << i for i in range(64) if r["v"][w + i] > 0) for w in range(0, 256, 64)]
        assert [c % (1 << 64) for c in r["c"]] == bits
        low, high = min(r["v"]), max(r["v"])
        assert r["q"]["shift"] == pytest.approx(low + 128 * (high - low) / 255, abs=1e-6) and min(r["q"]["code"]) == -128 and max(r["q"]["code"]) == 127
    assert len(out) == 400


def test_a_batch_of_pages_is_parsed_in_parts():
    """One batch from Spark may hold 64 MB of pages."""
    import pyarrow as pa

    from sparkseek.sources import markup

    pages = ["<p>" + "word " * 2_000 + "</p>"] * 200 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], names=["id", "html"])
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
    out = list(markup.parsed(iter([batch, batch]), lambda page: [(len(page),)] * 3, schema))
    assert sum(b.num_rows for b in out) == 2 * 3 * len(pages) and len(out) >= 6 and max(b.num_rows for b in out) <= 3 * 60
    assert [r["n"] for b in out for r in b.to_pylist()][: 3 * len(pages)] == [len(p or "") for p in pages for _ in range(3)]
