"""Queries of nearest vectors: exact, coded, clustered, and merged with text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector_search as VS
from ..plans.search import search
from ..schema import SearchSchema
from ..sources import shards as S
from ..sources.index import Index, vectors
from .base import DOCS_SQL, ORDER, documents, events_sql, index_sql, kept, scored, scores_sql, table, words_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIZE = 64


def embeddings(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        rows = table(spark, sf_dir, "embeddings").withColumn("seq", F.col("vec_id") + 1)
        return Index.build(rows, {"embedding": f"vector[{SIZE}]", "label": "number"})

    return kept(spark, sf_dir, "embeddings", build)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that the queries ask with: that of item 7."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"])


_UNIT = "list_transform({0}, lambda x: x::DOUBLE / {1})"
#: q: the query's unit vector; e: unit vectors in float.
BASE = f"""qv AS (SELECT embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS m FROM embeddings WHERE vec_id = 7),
qu AS (SELECT {_UNIT.format('v', 'm')} AS q FROM qv), em AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS m FROM embeddings),
e AS (SELECT vec_id + 1 AS seq, vec_id, label, list_transform(list_transform(embedding, lambda x: (x::DOUBLE / m)::FLOAT), lambda x: x::DOUBLE) AS v FROM em),
s AS (SELECT seq, vec_id, label, v, q, greatest(-1, least(1, list_dot_product(v, q))) AS score FROM e CROSS JOIN qu)"""


def _near(name: str, sql: str, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vector = {"property": "embedding", "value": query_vector(spark, sf_dir)}
        return scored(search(embeddings(spark, sf_dir), mode="vector", vector=vector, **request).hits, "vec_id")

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"WITH {BASE} SELECT vec_id, round(score, 6) AS score FROM s {sql}"


_near("knn_flat", f"WHERE score >= 0.1 {ORDER} LIMIT 20", similarity=0.1, limit=20)
_near("knn_default_similarity", f"WHERE score >= 0.8 {ORDER} LIMIT 10")
_near("knn_where_label", f"WHERE score >= -0.2 AND label = 2 {ORDER} LIMIT 20", similarity=-0.2, limit=20, where={"label": {"eq": 2}})


def knn_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [{"from": 0, "to": 1}, {"from": 2, "to": 4}, {"from": 5, "to": 9}]
    r = search(embeddings(spark, sf_dir), mode="vector", vector={"property": "embedding", "value": query_vector(spark, sf_dir)}, similarity=0.0, facets={"label": {"ranges": ranges}})
    return r.facets["label"]


QUERIES["knn_facets"] = knn_facets
ORACLES["knn_facets"] = f"WITH {BASE}, k AS (SELECT label FROM s WHERE score >= 0) " + " UNION ALL ".join(
    f"SELECT '{a}-{b}' AS value, count(*) FILTER (label BETWEEN {a} AND {b}) AS count FROM k" for a, b in ((0, 1), (2, 4), (5, 9))
)


def knn_vectors_in_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits have no vectors unless they are asked for."""
    how = {"mode": "vector", "vector": {"property": "embedding", "value": query_vector(spark, sf_dir)}, "similarity": 0.1, "limit": 5}
    ix = embeddings(spark, sf_dir)
    without, within = (search(ix, include_vectors=w, **how).hits.select("vec_id", F.lit(w).alias("asked"), F.size(F.coalesce("embedding", F.array().cast("array<float>"))).alias("dims")) for w in (False, True))
    return without.unionAll(within)


QUERIES["knn_vectors_in_hits"] = knn_vectors_in_hits
ORACLES["knn_vectors_in_hits"] = f"WITH {BASE}, t AS (SELECT vec_id FROM s WHERE score >= 0.1 {ORDER} LIMIT 5) SELECT vec_id, false AS asked, 0::INTEGER AS dims FROM t UNION ALL SELECT vec_id, true, {SIZE} FROM t"


def _coded(name: str, sql: str, find) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = find(embeddings(spark, sf_dir), query_vector(spark, sf_dir))
        return scored(found.withColumn("vec_id", F.col("seq") - 1), "vec_id")

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"WITH {BASE}, {sql}"


_bits = "b AS (SELECT seq, vec_id, score AS exact, cos(pi() * list_sum(list_transform(list_zip(v, q), lambda p: ((p[1] > 0) <> (p[2] > 0))::INTEGER)) / 64) AS score FROM s)"
_top = "SELECT vec_id, round(score, 6) AS score FROM {0} " + ORDER + " LIMIT 10"
_again = "r AS (SELECT seq, vec_id, exact AS score FROM {0} " + ORDER.replace("round(score, 9)", "round({0}.score, 9)") + " LIMIT 100)"
_coded("knn_binary", f"{_bits} {_top.format('b')}", lambda ix, q: VS.binary(ix, "embedding", q, 10, rescore=None))
_coded("knn_binary_rescored", f"{_bits}, {_again.format('b')} {_top.format('r')}", lambda ix, q: VS.binary(ix, "embedding", q, 10))
_coded(
    "knn_binary_margin",
    f"{_bits} SELECT vec_id, round(exact, 6) AS score FROM b WHERE score >= 0.05 AND exact >= 0.2",
    lambda ix, q: VS.binary(ix, "embedding", q, similarity=0.2),
)
_codes = """i0 AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM s), i1 AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 255 ELSE 0 END AS step FROM i0),
i AS (SELECT seq, vec_id, score AS exact, greatest(-1, least(1, list_sum(q) * ((lo + 128 * step)::FLOAT)::DOUBLE
  + (step::FLOAT)::DOUBLE * list_dot_product(q, list_transform(v, lambda x: CASE WHEN step > 0 THEN round((x - lo) / step) ELSE 0 END - 128)))) AS score FROM i1)"""
_coded("knn_int8", f"{_codes} {_top.format('i')}", lambda ix, q: VS.int8(ix, "embedding", q, 10, rescore=None))
_coded("knn_int8_rescored", f"{_codes}, {_again.format('i')} {_top.format('r')}", lambda ix, q: VS.int8(ix, "embedding", q, 10))
_coded(
    "knn_binary_int8",
    f"{_bits}, {_codes}, c AS (SELECT b.seq, b.vec_id, i.score FROM (SELECT * FROM b {ORDER} LIMIT 100) b JOIN i USING (seq)) {_top.format('c')}",
    lambda ix, q: VS.binary(ix, "embedding", q, 10, rescore="int8"),
)


def _ivf(spark: SparkSession, sf_dir: str) -> VS.Ivf:
    return kept(spark, sf_dir, "embeddings in clusters", lambda: VS.Ivf(embeddings(spark, sf_dir), "embedding", nlist=16))


def knn_ivf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every cluster probed, the inverted file gives the exact list."""
    ivf = _ivf(spark, sf_dir)
    found = ivf.search(query_vector(spark, sf_dir), 0.1, nprobe=ivf.nlist)
    return scored(found.withColumn("vec_id", F.col("seq") - 1), "vec_id")


QUERIES["knn_ivf_all"], ORACLES["knn_ivf_all"] = knn_ivf_all, f"WITH {BASE} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.1"


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters that may hold what is asked."""
    return scored(_ivf(spark, sf_dir).search(query_vector(spark, sf_dir), 0.1).withColumn("vec_id", F.col("seq") - 1), "vec_id")


def knn_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes, then exact scores of all that may be among the best."""
    pq = kept(spark, sf_dir, "embeddings in product codes", lambda: VS.ProductQuantizer(embeddings(spark, sf_dir), "embedding"))
    return scored(pq.search(query_vector(spark, sf_dir), 10).withColumn("vec_id", F.col("seq") - 1), "vec_id")


QUERIES |= {"knn_ivf": knn_ivf, "knn_pq": knn_pq}
# Nothing that counts is left out, so both give the exact lists.
ORACLES |= {"knn_ivf": ORACLES["knn_ivf_all"], "knn_pq": f"WITH {BASE} {_top.format('s')}"}

def _by_index(name: str, how, sql: str, **request) -> None:
    """A search by the index that the schema's property names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = kept(spark, sf_dir, name, lambda: replace(embeddings(spark, sf_dir), vector_indexes={"embedding": how}))
        vector = {"property": "embedding", "value": query_vector(spark, sf_dir)}
        return scored(search(ix, mode="vector", vector=vector, **request).hits, "vec_id")

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"WITH {BASE}{sql}"


_far = f" SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.1 {ORDER} LIMIT 20"
_by_index("knn_search_ivf", {"kind": "ivf", "nlist": 16}, _far, similarity=0.1, limit=20)
_by_index("knn_search_pq", "pq", _far, similarity=0.1, limit=20)
_by_index("knn_search_ivf_where", {"kind": "ivf", "nlist": 16}, f" SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= -0.2 AND label = 2 {ORDER} LIMIT 20", similarity=-0.2, limit=20, where={"label": {"eq": 2}})
_by_index("knn_search_binary", "binary", f", {_bits} SELECT vec_id, round(exact, 6) AS score FROM b WHERE score >= 0.05 AND exact >= 0.2 ORDER BY round(exact, 9) DESC, seq LIMIT 20", similarity=0.2, limit=20)
_by_index("knn_search_int8", {"kind": "int8", "rescore": None}, f", {_codes} SELECT vec_id, round(score, 6) AS score FROM i WHERE score >= 0.1 {ORDER} LIMIT 20", similarity=0.1, limit=20)

# -- text and vectors ----------------------------------------------------------------------


def both(spark: SparkSession, sf_dir: str) -> Index:
    """Documents with the vector of the same number, where there is one."""

    def build() -> Index:
        ix = documents(spark, sf_dir)
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        return replace(ix, docs=ix.docs.join(e, "doc_id", "left"), schema=SearchSchema(ix.schema.fields | {"embedding": f"vector[{SIZE}]"}))

    return kept(spark, sf_dir, "documents and vectors", build)


def _hybrid(name: str, weights: tuple[float, float], allowed: str = "true", **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vector = {"property": "embedding", "value": query_vector(spark, sf_dir)}
        how = {"term": "hean und", "properties": ["text"], "prefix": False, "similarity": 0.05, "limit": 30}
        return scored(search(both(spark, sf_dir), mode="hybrid", vector=vector, **(how | request)).hits, "doc_id")

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"""WITH {index_sql({'text': words_sql('text')})}, {events_sql(['hean', 'und'], ['text'], 'exact')}, {scores_sql(2, allowed=allowed)}, {BASE.replace('s AS (SELECT seq, vec_id, label, v, q', 'sv AS (SELECT seq, vec_id, label, v, q')},
t AS (SELECT seq, score / (SELECT max(score) FROM sc) AS t FROM sc), nv AS (SELECT seq, score FROM sv WHERE score >= 0.05 AND seq IN (SELECT seq FROM docs WHERE {allowed})),
w AS (SELECT seq, score / (SELECT max(score) FROM nv) AS v FROM nv),
h AS (SELECT seq, coalesce(t, 0) * {weights[0]} + coalesce(v, 0) * {weights[1]} AS score FROM t FULL JOIN w USING (seq))
SELECT seq - 1 AS doc_id, round(score, 6) AS score FROM h {ORDER} LIMIT 30"""


_hybrid("hybrid_default", (0.5, 0.5))
_hybrid("hybrid_weights", (0.8, 0.2), hybrid_weights=(0.8, 0.2))
_hybrid("hybrid_where", (0.5, 0.5), "lang = 'en'", where={"lang": {"eq": "en"}})


def vector_cones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shard (here: label) the most that a vector of it can be like the query."""
    from ..functions.vectors import unit

    rows = vectors(embeddings(spark, sf_dir), "embedding", "label")
    found = S.surviving(S.cones(rows, "label", SIZE), unit(query_vector(spark, sf_dir)), 0.0)
    return found.select("label", F.round("angle", 5).alias("angle"), F.round("bound", 5).alias("bound"))


QUERIES["vector_cones"] = vector_cones
ORACLES["vector_cones"] = f"""WITH {BASE}, u AS (SELECT label, seq, unnest({_UNIT.format('v', 'sqrt(list_dot_product(v, v))')}) AS x, generate_subscripts(v, 1) AS d FROM e),
c0 AS (SELECT label, d, sum(x) AS x FROM u GROUP BY ALL), c1 AS (SELECT label, list(x ORDER BY d) AS c FROM c0 GROUP BY label), c AS (SELECT label, {_UNIT.format('c', 'sqrt(list_dot_product(c, c))')} AS c FROM c1),
a AS (SELECT label, max(acos(greatest(-1, least(1, list_dot_product({_UNIT.format('v', 'sqrt(list_dot_product(v, v))')}, c))))) AS angle FROM e JOIN c USING (label) GROUP BY label),
b AS (SELECT label, angle, cos(greatest(0, acos(greatest(-1, least(1, list_dot_product(c, q)))) - angle)) AS bound FROM a JOIN c USING (label) CROSS JOIN qu)
SELECT label, round(angle, 5) AS angle, round(bound, 5) AS bound FROM b WHERE bound >= 0"""


def vector_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three shards (here: labels) of nearest centroids, of those that may hold a match."""
    from ..functions.vectors import unit

    rows = vectors(embeddings(spark, sf_dir), "embedding", "label")
    found = S.probed(S.cones(rows, "label", SIZE), unit(query_vector(spark, sf_dir)), 0.0, 3, "label")
    return found.select("label", F.round("nearness", 5).alias("nearness"))


QUERIES["vector_probe"] = vector_probe
ORACLES["vector_probe"] = (
    ORACLES["vector_cones"].split("\nb AS (")[0]
    + "\nb AS (SELECT label, list_dot_product(c, q) AS near, cos(greatest(0, acos(greatest(-1, least(1, list_dot_product(c, q)))) - angle)) AS bound FROM a JOIN c USING (label) CROSS JOIN qu)"
    + " SELECT label, round(near, 5) AS nearness FROM b WHERE bound >= 0 ORDER BY round(near, 9) DESC, label LIMIT 3"
)
