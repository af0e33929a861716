"""The index of a collection: tables of documents, postings and vectors.

docs      the stored columns, with id (string) and seq (long): the order of
          insertion, which breaks all ties
postings  prop, term, seq, tf, len: a row for each word of a field; len is the
          field's length, so scoring needs no second join
terms     prop, term, df
Field averages and the number of documents are one small row a property.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions.text import Analyzer
from ..functions.vectors import let
from ..schema import SearchSchema, vector_size
from .numbering import numbered


def ordered(docs: DataFrame, *order: str) -> DataFrame:
    """docs with seq, 1 up in the given order."""
    return numbered(docs, "seq", [F.col(c) for c in order])


def field_text(df: DataFrame, prop: str, kind: str) -> Column:
    """An array of strings is one field: its parts' words follow each other."""
    return F.array_join(F.col(prop), " \n ") if kind.endswith("[]") else F.col(prop)


class Numbers:
    """The number of documents and the mean field lengths, each counted when first asked for."""

    def __init__(self, count: Callable[[], int], means: Callable[[int], dict[str, float]]):
        self._count, self._means = count, means

    @classmethod
    def of(cls, docs: DataFrame, postings: DataFrame, schema: SearchSchema) -> Numbers:
        return cls(docs.count, lambda n: field_averages(docs, postings, schema, n))

    @cached_property
    def n_docs(self) -> int:
        return self._count()

    @cached_property
    def averages(self) -> dict[str, float]:
        return self._means(self.n_docs)


def dictionary(postings: DataFrame) -> DataFrame:
    """prop, term, df. Not kept: a search asks for a few words, a filter that reaches
    the postings, and counting all others would cost more than the search."""
    return postings.groupBy("prop", "term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    docs: DataFrame
    schema: SearchSchema
    analyzer: Analyzer
    postings: DataFrame
    terms: DataFrame
    numbers: Numbers
    language: str = "english"
    excluded: frozenset[str] = field(default_factory=frozenset)
    pins: dict[str, dict] = field(default_factory=dict)
    hooks: dict[str, list] = field(default_factory=dict)
    #: Property ("*": all others) to a kind of vector index, {"kind": .., options}, or
    #: a callable (index, property) that makes one.
    vector_indexes: dict[str, object] = field(default_factory=dict)
    #: Vector indexes of this version, made when first searched.
    _fitted: dict[str, object] = field(default_factory=dict, init=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @property
    def n_docs(self) -> int:
        return self.numbers.n_docs

    @property
    def averages(self) -> dict[str, float]:
        return self.numbers.averages

    @classmethod
    def build(cls, docs: DataFrame, schema: SearchSchema | dict | None = None, analyzer: Analyzer | None = None, exclude: tuple[str, ...] = (), cache: bool = True, vector_indexes: dict[str, object] | None = None) -> Index:
        """docs must have seq, and id (else seq serves as id)."""
        if schema is None:
            schema = SearchSchema.infer(docs)
        elif isinstance(schema, dict):
            schema = SearchSchema.parse(schema)
        analyzer = analyzer or Analyzer()
        if bad := schema.invalid(docs):
            raise SeekError("SCHEMA_VALIDATION_FAILURE", bad)
        if "id" not in docs.columns:
            docs = docs.withColumn("id", F.col("seq").cast("string"))
        docs = docs.withColumn("seq", F.col("seq").cast("long"))
        postings = build_postings(docs, schema, analyzer, cache)
        stored = docs.drop(*[c for c in exclude if c in docs.columns])
        return cls(stored, schema, analyzer, postings, dictionary(postings), Numbers.of(docs, postings, schema), analyzer.language, frozenset(exclude), vector_indexes=dict(vector_indexes or {}))

    def with_statistics_of(self, other: Index) -> Index:
        """These documents, scored by the numbers of another index: a part of a
        collection ranks as the whole would."""
        return replace(self, terms=other.terms, numbers=other.numbers)

    def save(self, path: str) -> None:
        """Sorted by word, so that row groups are ranges of words that a scan can
        skip; with a Bloom filter for single words."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        p = self.postings.repartitionByRange("prop", "term").sortWithinPartitions("prop", "term", "seq")
        p.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
        rows = [(p, k, self.averages.get(p)) for p, k in self.schema.fields.items()]
        meta = self.spark.createDataFrame(rows, "prop string, kind string, average double")
        meta.withColumn("n_docs", F.lit(self.n_docs)).withColumn("language", F.lit(self.language)).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> Index:
        meta = spark.read.parquet(f"{path}/meta").collect()
        postings = spark.read.parquet(f"{path}/postings")
        averages = {r["prop"]: r["average"] for r in meta if r["average"] is not None}
        return cls(
            spark.read.parquet(f"{path}/docs"), SearchSchema({r["prop"]: r["kind"] for r in meta}), analyzer or Analyzer(meta[0]["language"]), postings, dictionary(postings),
            Numbers(lambda: meta[0]["n_docs"], lambda n: averages), meta[0]["language"],
        )

    # -- changes: each gives a new version ------------------------------------------------

    def get(self, doc_id: str) -> DataFrame:
        return self.docs.where(F.col("id") == doc_id)

    def insert(self, rows: DataFrame) -> Index:
        """All rows or, if an id is there already or comes twice, none."""
        self._checked(rows)
        if not rows.join(self.docs.select("id"), "id", "left_semi").isEmpty() or not rows.groupBy("id").count().where("count > 1").isEmpty():
            raise SeekError("DOCUMENT_ALREADY_EXISTS")
        return self._plus(rows, self.docs, self.postings)

    def remove(self, ids: DataFrame | list[str]) -> Index:
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        return self._version(*self._without(ids))

    def _without(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Documents and postings without some ids."""
        gone = self.docs.join(ids.select("id"), "id", "left_semi").select("seq")
        return self.docs.join(gone, "seq", "left_anti"), self.postings.join(gone, "seq", "left_anti")

    def upsert(self, rows: DataFrame) -> Index:
        """Rows with known ids take those documents' places; all come last in order."""
        self._checked(rows)
        return self._plus(rows, *self._without(rows.select("id").distinct()))

    update = upsert

    def _checked(self, rows: DataFrame) -> None:
        if dict(rows.dtypes).get("id") != "string":
            raise SeekError("DOCUMENT_ID_MUST_BE_STRING")
        if bad := self.schema.invalid(rows):
            raise SeekError("SCHEMA_VALIDATION_FAILURE", bad)

    def _plus(self, rows: DataFrame, docs: DataFrame, postings: DataFrame) -> Index:
        top = self.docs.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        return self.with_rows(ordered(rows, "id").withColumn("seq", F.col("seq") + top), docs, postings)

    def with_rows(self, fresh: DataFrame, docs: DataFrame | None = None, postings: DataFrame | None = None) -> Index:
        """A version with further rows, whose ids are new and whose seq is given; in
        place of its own, other documents and postings may be what they join."""
        unstored = self.excluded | {f.split(".")[0] for f in self.schema.fields} - set(self.docs.columns)
        docs = (self.docs if docs is None else docs).unionByName(fresh.drop(*unstored), allowMissingColumns=True)
        postings = (self.postings if postings is None else postings).unionByName(build_postings(fresh, self.schema, self.analyzer, cache=True))
        return self._version(docs, postings)

    def _version(self, docs: DataFrame, postings: DataFrame) -> Index:
        return Index(docs, self.schema, self.analyzer, postings, dictionary(postings), Numbers.of(docs, postings, self.schema), self.language, self.excluded, dict(self.pins), self.hooks, dict(self.vector_indexes))


def build_postings(docs: DataFrame, schema: SearchSchema, analyzer: Analyzer, cache: bool = False) -> DataFrame:
    """prop, term, seq, tf, len; with cache, documents' counted words are kept."""
    counted = count_words(docs, schema, analyzer)
    return spread(counted.persist(StorageLevel.MEMORY_AND_DISK) if cache else counted)


def count_words(docs: DataFrame, schema: SearchSchema, analyzer: Analyzer) -> DataFrame:
    """prop, seq, len, terms, tfs: a row for each field of a document, with its
    different words and how often it has each.

    Words are cut, stemmed and counted within the row: none is shuffled.
    """
    parts = []
    for prop in schema.strings():
        if prop.split(".")[0] not in docs.columns:
            continue  # missing properties are legal
        words = analyzer.words(field_text(docs, prop, schema.fields[prop]), prop)
        rows = docs.where(F.col(prop).isNotNull()).select("seq", words.alias("w"))
        length = F.size("w")
        if stem := analyzer.stems(prop):
            rows, length = rows.select("seq", F.size("w").alias("len"), F.filter(_stems(stem)("w"), lambda w: w != "").alias("w")), F.col("len")
            if not analyzer.allow_duplicates:
                rows, length = rows.select("seq", F.array_distinct("w").alias("w")), F.size("w")
        rows = rows.select("seq", length.alias("len"), _counted(F.col("w")).alias("c"))
        parts.append(rows.select(F.lit(prop).alias("prop"), "seq", "len", "c.terms", "c.tfs"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "prop string, seq long, len int, terms array<string>, tfs array<int>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def spread(counted: DataFrame) -> DataFrame:
    """A row for each word: prop, term, seq, tf, len."""
    # Of an inner explode Spark would ask beforehand whether there are words, and cut all texts once more for that.
    rows = counted.select("prop", "seq", "len", "tfs", F.posexplode_outer("terms").alias("k", "term")).where("term IS NOT NULL")
    return rows.select("prop", "term", "seq", F.get("tfs", F.col("k")).cast("long").alias("tf"), "len")


def _counted(words: Column) -> Column:
    """struct(terms, tfs) of an array of words: runs of it when sorted."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        terms = lambda at: F.transform(at, lambda i: F.get(s, i))
        tfs = lambda at: F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i)
        return let(first, lambda at: F.struct(terms(at).alias("terms"), tfs(at).alias("tfs")))

    return let(F.sort_array(words), runs)


#: Words whose stems a task remembers.
MOST_STEMS = 200_000


def _stems(stem):
    """Stems of arrays of words; a word is stemmed once for a batch, and mostly once for a task."""
    known: dict[str, str | None] = {}

    @F.arrow_udf("array<string>")
    def stems(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        each = coded.dictionary.to_pylist()
        if len(known) > MOST_STEMS:
            known.clear()
        for w in each:
            if w not in known:
                known[w] = stem(w)
        ends = np.cumsum([0, *pc.list_value_length(words).fill_null(0).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([known[w] for w in each], pa.string()).take(coded.indices))

    return stems


def field_averages(docs: DataFrame, postings: DataFrame, schema: SearchSchema, n_docs: int) -> dict[str, float]:
    """Mean field length over all documents, as it stands after the last insert.

    A document without the property leaves the running mean as it is, so with
    gaps the mean depends on their places; without gaps it is sum / N.
    """
    props = schema.strings()
    if not props or not n_docs:
        return {}
    # Of a field that is not stored only its words are known: it counts as without gaps.
    there = docs.agg(*[(F.count(p) if p.split(".")[0] in docs.columns else F.count("*")).alias(f"c{i}") for i, p in enumerate(props)]).first()
    sums = {r["prop"]: r["s"] for r in postings.groupBy("prop").agg(F.sum("tf").alias("s")).collect()}
    out = {}
    for i, p in enumerate(props):
        if there[i] == n_docs:
            out[p] = (sums.get(p) or 0) / n_docs
        elif there[i]:
            out[p] = _running_mean(docs, postings, p, n_docs)
    return out


def _running_mean(docs: DataFrame, postings: DataFrame, prop: str, n_docs: int) -> float:
    """(1/N) * sum of L_i times the product of j / (j - 1) over later gaps j."""
    lengths = postings.where(F.col("prop") == prop).select("seq", F.col("len").alias("l")).distinct()
    rows = ordered(docs.select(F.col("seq").alias("s0"), F.col(prop).isNull().alias("gap")), "s0").join(lengths.withColumnRenamed("seq", "s0"), "s0", "left")
    step = F.when(F.col("gap") & (F.col("seq") > 1), F.log(F.col("seq") / (F.col("seq") - 1))).otherwise(0.0)
    part = F.floor(F.col("seq") / 65_536)
    rows = rows.select("seq", part.alias("part"), F.coalesce("l", F.lit(0)).alias("l"), step.alias("g"))
    # From the last row on: a frame that ends at the last is summed anew for each row.
    later = F.coalesce(F.sum("g").over(Window.partitionBy("part").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = rows.withColumn("x", F.col("l") * F.exp(later)).groupBy("part").agg(F.sum("x").alias("x"), F.sum("g").alias("g"))
    after = F.coalesce(F.sum("g").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return parts.withColumn("y", F.col("x") * F.exp(after)).agg(F.sum("y")).first()[0] / n_docs


def vectors(index: Index, prop: str, *columns: str) -> DataFrame:
    """seq, v, further columns: the property's vectors scaled to length 1, as float."""
    from ..functions.vectors import normalized

    kind = index.schema.fields.get(prop)
    if kind is None or not vector_size(kind):
        raise SeekError("UNKNOWN_VECTOR_PROPERTY", prop)
    return index.docs.where(F.col(prop).isNotNull()).select("seq", normalized(F.col(prop)).alias("v"), *columns)
