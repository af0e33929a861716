"""Nearest vectors: exact, inverted file, coded with rescoring, product codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions import vectors as V
from ..schema import vector_size
from ..sources.index import Index, vectors

SIMILARITY = 0.8
OVERSAMPLE, RESCORE_MARGIN = 10, 0.15
#: What bounds allow for rounding.
SLACK = 1e-3


def _query(index: Index, prop: str, value: list[float]) -> list[float] | None:
    size = vector_size(index.schema.fields.get(prop, ""))
    if size is None:
        raise SeekError("UNKNOWN_VECTOR_PROPERTY", prop)
    return V.unit(value, size)


def flat(index: Index, prop: str, value: list[float], similarity: float = SIMILARITY, allowed: DataFrame | None = None) -> DataFrame:
    """seq, score of all documents at least so similar."""
    q = _query(index, prop, value)
    rows = vectors(index, prop)
    if allowed is not None:
        rows = rows.join(allowed.select("seq"), "seq", "left_semi")
    if q is None:
        return rows.select("seq", F.lit(0.0).alias("score")).where("false")
    return rows.select("seq", V.clamped(V.dot(F.col("v"), V.literal(q))).alias("score")).where(F.col("score") >= similarity)


def kmeans(rows: DataFrame, k: int, seed: int = 7, sample: int = 50_000) -> np.ndarray:
    """Centroids by the library's k-means on a bounded sample, scaled to length 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    part = rows.sample(False, min(1.0, sample / max(n, 1)), seed) if n > sample else rows
    model = KMeans(k=k, seed=seed, maxIter=20, distanceMeasure="cosine").fit(part.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    c = np.array([x for x in model.clusterCenters()])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with `cluster`, the nearest centroid by dot product."""
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v.to_numpy()) @ centroids.T).argmax(axis=1)) if len(v) else pd.Series([], dtype="int32")

    return rows.withColumn("cluster", nearest("v"))


class Ivf:
    """Vectors dealt to clusters; a query reads the clusters that may hold what it asks.

    Those are the clusters whose centroid is within the angle of the similarity and
    the cluster's own radius: nothing is missed. With nprobe, only the so many
    nearest are read, and what lies in others is.
    """

    def __init__(self, index: Index, prop: str, nlist: int = 64, nprobe: int | None = None):
        self.index, self.prop = index, prop
        rows = vectors(index, prop)
        self.nlist = max(1, min(nlist, rows.count()))
        self.nprobe = nprobe
        self.centroids = kmeans(rows, self.nlist)
        self.rows = assign(rows, self.centroids)
        self.radius = self._radii()

    def _radii(self) -> np.ndarray:
        """The largest angle between each centroid and a vector of its cluster."""
        centroids = self.centroids

        @F.pandas_udf("double")
        def angle(v: pd.Series, cluster: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="float64")
            dots = (np.stack(v.to_numpy()) * centroids[cluster.to_numpy()]).sum(axis=1)
            return pd.Series(np.arccos(np.clip(dots, -1, 1)))

        # One row a cluster.
        most = {r["cluster"]: r["a"] for r in self.rows.groupBy("cluster").agg(F.max(angle("v", "cluster")).alias("a")).collect()}
        return np.array([most.get(c, -np.inf) for c in range(len(centroids))])

    def probed(self, q: list[float], similarity: float) -> list[int]:
        """Clusters that may hold a vector so similar to the unit vector q."""
        angles = np.arccos(np.clip(self.centroids @ np.array(q), -1, 1))
        # Unit vectors in float are not quite of length 1.
        return np.flatnonzero(angles - self.radius <= np.arccos(np.clip(similarity, -1, 1)) + SLACK).tolist()

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cluster").parquet(path)
        self.rows = self.index.spark.read.parquet(path)

    def near(self, value: list[float], similarity: float) -> DataFrame:
        return self.search(value, similarity)

    def search(self, value: list[float], similarity: float = SIMILARITY, nprobe: int | None = None) -> DataFrame:
        q = _query(self.index, self.prop, value)
        if q is None:
            return self.rows.select("seq", F.lit(0.0).alias("score")).where("false")
        some = nprobe or self.nprobe
        probed = np.argsort(-(self.centroids @ np.array(q)), kind="stable")[:some].tolist() if some else self.probed(q, similarity)
        near = self.rows.where(F.col("cluster").isin(probed))
        return near.select("seq", V.clamped(V.dot(F.col("v"), V.literal(q))).alias("score")).where(F.col("score") >= similarity)


def _two_steps(rows: DataFrame, q: list[float], k: int | None, similarity: float | None, rescore: str | None, oversample: int) -> DataFrame:
    """seq, score from rows (seq, v, code score): the best by code, scored again.

    With k, the k * oversample best by code are scored again; with a similarity
    alone, all whose code comes within RESCORE_MARGIN of it.
    """
    order = [F.desc(F.round("score", 9)), F.asc("seq")]
    if rescore is None:
        out = rows.select("seq", "score")
    else:
        some = rows.orderBy(*order).limit(k * oversample) if k else rows.where(F.col("score") >= (similarity or 0.0) - RESCORE_MARGIN)
        exact = V.clamped(V.dot(F.col("v"), V.literal(q)))
        if rescore == "int8":
            exact = V.int8_score(V.literal(q), V.int8_code(F.col("v")), F.lit(sum(q)))
        out = some.select("seq", exact.alias("score"))
    if similarity is not None:
        out = out.where(F.col("score") >= similarity)
    return out.orderBy(*order).limit(k) if k else out


class Coded:
    """Sign bits ("binary") or 8-bit codes ("int8") as columns beside the vectors."""

    def __init__(self, index: Index, prop: str, kind: str, rescore: str | None = "float32", oversample: int = OVERSAMPLE):
        self.index, self.prop, self.kind, self.rescore, self.oversample = index, prop, kind, rescore, oversample
        self.size = vector_size(index.schema.fields.get(prop, ""))
        code = V.sign_words(F.col("v"), self.size or 0) if kind == "binary" and self.size else V.int8_code(F.col("v"))
        self.rows = vectors(index, prop).withColumn("c", code)

    def _score(self, q: list[float]) -> Column:
        if self.kind == "int8":
            return V.int8_score(V.literal(q), F.col("c"), F.lit(sum(q)))
        words = [sum(1 << (i % 64) for i in range(w, min(w + 64, self.size)) if q[i] > 0) for w in range(0, self.size, 64)]
        signs = F.array(*[F.lit(w - (1 << 64) if w >= 1 << 63 else w).cast("long") for w in words])
        return V.binary_score(V.hamming(F.col("c"), signs), self.size)

    def near(self, value: list[float], similarity: float) -> DataFrame:
        return self.search(value, None, similarity)

    def search(self, value: list[float], k: int | None = None, similarity: float | None = None) -> DataFrame:
        q = _query(self.index, self.prop, value)
        if q is None:
            return self.rows.select("seq", F.lit(0.0).alias("score")).where("false")
        rows = self.rows.select("seq", "v", self._score(q).alias("score"))
        return _two_steps(rows, q, k, similarity, self.rescore, self.oversample)


def binary(index: Index, prop: str, value: list[float], k: int | None = None, rescore: str | None = "float32", oversample: int = OVERSAMPLE, similarity: float | None = None) -> DataFrame:
    """seq, score by sign bits; with rescore ("int8" or "float32") in two steps."""
    return Coded(index, prop, "binary", rescore, oversample).search(value, k, similarity)


def int8(index: Index, prop: str, value: list[float], k: int | None = None, rescore: str | None = "float32", oversample: int = OVERSAMPLE, similarity: float | None = None) -> DataFrame:
    """seq, score by 8-bit codes; with rescore ("float32") in two steps."""
    return Coded(index, prop, "int8", rescore, oversample).search(value, k, similarity)


class ProductQuantizer:
    """m codebooks of up to 256 centroids each; scores by table lookups.

    A row has the length `off` of what its code leaves out, which bounds how far the
    score by code can be from the exact one.
    """

    def __init__(self, index: Index, prop: str, m: int = 8, ks: int = 32, seed: int = 7, sample: int = 20_000):
        self.index, self.prop = index, prop
        size = vector_size(index.schema.fields[prop])
        if size % m:
            raise SeekError("INVALID_VECTOR_SIZE", f"{size} is not a multiple of {m}")
        self.m, self.width = m, size // m
        rows = vectors(index, prop)
        n = rows.count()
        part = rows.sample(False, min(1.0, sample / max(n, 1)), seed) if n > sample else rows
        x = np.stack([np.array(r["v"], np.float32) for r in part.select("seq", "v").orderBy("seq").limit(sample).collect()])
        rng = np.random.default_rng(seed)
        self.books = [self._lloyd(x[:, j * self.width : (j + 1) * self.width], min(ks, len(x)), rng) for j in range(m)]
        self.rows = self._encoded(rows)

    @staticmethod
    def _lloyd(x: np.ndarray, k: int, rng) -> np.ndarray:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(20):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            for j in range(k):
                if (near == j).any():
                    c[j] = x[near == j].mean(axis=0)
        return c

    def _encoded(self, rows: DataFrame) -> DataFrame:
        books, width = self.books, self.width

        @F.pandas_udf("code binary, off double")
        def code(v: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"code": pd.Series([], dtype=object), "off": pd.Series([], dtype="float64")})
            x = np.stack(v.to_numpy())
            far = [((x[:, None, j * width : (j + 1) * width] - b[None]) ** 2).sum(axis=2) for j, b in enumerate(books)]
            near = np.stack([f.argmin(axis=1) for f in far], axis=1).astype(np.uint8)
            return pd.DataFrame({"code": [bytes(r) for r in near], "off": np.sqrt(sum(f.min(axis=1).astype(np.float64) for f in far))})

        return rows.withColumn("_c", code("v")).select(*rows.columns, "_c.code", "_c.off")

    def _scored(self, q: list[float]) -> DataFrame:
        """The rows with the score by code, s."""
        lut = np.stack([b @ np.array(q[j * self.width : (j + 1) * self.width]) for j, b in enumerate(self.books)])

        @F.pandas_udf("double")
        def score(codes: pd.Series) -> pd.Series:
            c = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
            return pd.Series(lut[np.arange(lut.shape[0])[None, :], c].sum(axis=1))

        return self.rows.withColumn("s", score("code"))

    def near(self, value: list[float], similarity: float) -> DataFrame:
        """All at least so similar: exact scores of those whose code lets them be."""
        q = _query(self.index, self.prop, value)
        if q is None:
            return self.rows.select("seq", F.lit(0.0).alias("score")).where("false")
        may = self._scored(q).where(F.col("s") + F.col("off") >= similarity - SLACK)
        return may.select("seq", V.clamped(V.dot(F.col("v"), V.literal(q))).alias("score")).where(F.col("score") >= similarity)

    def search(self, value: list[float], k: int, oversample: int = OVERSAMPLE) -> DataFrame:
        q = _query(self.index, self.prop, value)
        if q is None:
            return self.rows.select("seq", F.lit(0.0).alias("score")).where("false")
        coded, exact = self._scored(q), V.clamped(V.dot(F.col("v"), V.literal(q)))
        some = coded.orderBy(F.desc("s"), "seq").limit(k * oversample).select(exact.alias("score"))
        # The k-th best of these is at most the k-th best of all: what cannot reach it
        # is none of the k.
        least = some.orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if least["n"] == k:
            coded = coded.where(F.col("s") + F.col("off") >= least["least"] - SLACK)
        return coded.select("seq", exact.alias("score")).orderBy(F.desc(F.round("score", 9)), "seq").limit(k)


# -- the index that a property names ---------------------------------------------------

MADE = {
    "ivf": Ivf,
    "binary": lambda index, prop, **how: Coded(index, prop, "binary", **how),
    "int8": lambda index, prop, **how: Coded(index, prop, "int8", **how),
    "pq": ProductQuantizer,
}


def _chosen(index: Index, prop: str):
    """What makes the property's index; None for a scan of the vectors themselves."""
    how = index.vector_indexes.get(prop, index.vector_indexes.get("*", "flat"))
    if callable(how):
        return how
    options = dict(how) if isinstance(how, dict) else {"kind": how}
    kind = options.pop("kind", None)
    if kind == "flat":
        return None
    if kind not in MADE:
        raise SeekError("UNSUPPORTED_COMPONENT", kind)
    return lambda ix, p: MADE[kind](ix, p, **options)


def refit(index: Index, prop: str):
    """The property's index, made anew; its coded rows are kept for the searches to come."""
    make = _chosen(index, prop)
    old = index._fitted.pop(prop, None)
    if isinstance(getattr(old, "rows", None), DataFrame):
        old.rows.unpersist()
    if make is None:
        return None
    made = make(index, prop)
    if isinstance(getattr(made, "rows", None), DataFrame):
        made.rows = made.rows.persist(StorageLevel.MEMORY_AND_DISK)
    index._fitted[prop] = made
    return made


def near(index: Index, prop: str, value: list[float], similarity: float = SIMILARITY, allowed: DataFrame | None = None) -> DataFrame:
    """seq, score of documents at least so similar, by the index that the property names."""
    if vector_size(index.schema.fields.get(prop, "")) is None or _chosen(index, prop) is None:
        return flat(index, prop, value, similarity, allowed)
    rows = (index._fitted.get(prop) or refit(index, prop)).near(value, similarity)
    return rows if allowed is None else rows.join(allowed.select("seq"), "seq", "left_semi")


def hybrid(text: DataFrame, near: DataFrame, weights: tuple[float, float] | None = None) -> DataFrame:
    """Full outer sum of two rankings, each divided by its own largest score."""
    wt, wv = weights or (0.5, 0.5)

    def scaled(df: DataFrame, name: str) -> DataFrame:
        most = df.agg(F.max("score").alias("m")).scalar()
        return df.select("seq", F.when(most > 0, F.col("score") / most).otherwise(0.0).alias(name))

    both = scaled(text, "t").join(scaled(near, "v"), "seq", "full_outer")
    return both.select("seq", (F.coalesce("t", F.lit(0.0)) * wt + F.coalesce("v", F.lit(0.0)) * wv).alias("score"))


def recall_at(found: DataFrame, exact: DataFrame) -> float:
    n = exact.count()
    return found.join(exact, "seq", "left_semi").count() / n if n else 1.0
