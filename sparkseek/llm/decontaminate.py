"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every item gives windows of ten consecutive words; an item of fewer words is a
window itself. Windows of one length form a machine with three tables:

* block shift: for the last words of the search window, how far the window can
  move with no chance of missing an occurrence,
* suffix buckets: windows keyed by their last block,
* the window itself, compared word by word.

Words are bytes of the UTF-8 text with A-Z lower-cased, so neither locale nor
Python's Unicode rules matter.

Defined results: null or wordless text has no words and no hits; a repeated item
id counts once; a null item id is left out; repeated documents each give a row;
with no items at all no word is hit. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, materialize, table

WINDOW = 10
#: Items travel to the workers in blocks of so many bytes of text; each block is
#: one scan of the documents, so no broadcast is larger than this.
BLOCK_BYTES = 32 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
HITS = "doc_id long, n_words long, hits array<int>, items array<long>"


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


class Machine:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[int]]):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for window in windows:
            for end in range(self.block, length + 1):
                key = self._key(window, end)
                left = length - end
                if left < self.shift.get(key, self.default):
                    self.shift[key] = left
            self.buckets.setdefault(self._key(window, length), set()).add(window)
        self.owners = windows

    def _key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, owners) of each occurrence."""
        length, default, shift, buckets = self.length, self.default, self.shift, self.buckets
        end, n, two = length, len(words), self.block == 2
        while end <= n:
            key = (words[end - 2], words[end - 1]) if two else words[end - 1]
            step = shift.get(key, default)
            if step:
                end += step
                continue
            window = tuple(words[end - length : end])
            if window in buckets[key]:
                yield end - length, self.owners[window]
            end += 1


class Matcher:
    def __init__(self, items: list[tuple[int, bytes | None]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for item, text in items:
            words = words_of(text)
            if item is None or not words:
                continue
            length = min(window, len(words))
            for i in range(len(words) - length + 1):
                owners = by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.machines = [Machine(k, v) for k, v in sorted(by_length.items())]

    def match(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Hit words as sorted [from, to) pairs laid flat, and the items found."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for m in self.machines:
            for start, owners in m.search(words):
                spans.append((start, start + m.length))
                found.update(owners)
        return merge_spans(spans), sorted(found)


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += (a, b)
    return flat


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes | None]]]:
    """The items in blocks of BLOCK_BYTES, fetched partition by partition."""
    block, size = [], 0
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).dropna(subset=["item_id"])
    for row in rows.toLocalIterator():
        text = bytes(row["text"]) if row["text"] is not None else None
        block.append((row["item_id"], text))
        size += len(text or b"") + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(docs: DataFrame, items: list, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, window)
        for batch in batches:
            n_words, hits, found = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                spans, owners = matcher.match(words)
                n_words.append(len(words))
                hits.append(spans)
                found.append(owners)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "hits", "items"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, hits, items over all items."""
    blocks = _blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(docs, first, window)
    # Rows are told apart by their place in the scan, so repeated ids stay apart; they
    # are written with it, once, as it would be another in another scan. Each further
    # block is a scan whose few hits come back by that place.
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text")).withColumn("at", F.monotonically_increasing_id())
    keyed = materialize(keyed, "placed-documents")
    placed = keyed.select(F.col("at").alias("doc_id"), "text")
    base = _scan(placed, first, window)
    for block in chain([second], blocks):
        base = base.unionAll(_scan(placed, block, window))
    merged = base.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    spans = F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.struct(F.get("hits", i).alias("a"), F.get("hits", i + 1).alias("b")))
    spans = F.when(F.size("hits") > 0, F.array_sort(spans)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    flat = F.aggregate(
        spans,
        F.array().cast("array<int>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["a"] <= F.get(acc, F.size(acc) - 1)),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.get(acc, F.size(acc) - 1), s["b"]))),
        ).otherwise(F.concat(acc, F.array(s["a"], s["b"]))),
    )
    return keyed.select("doc_id", "at").join(merged.withColumn("hits", flat).withColumnRenamed("doc_id", "at"), "at").drop("at")


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from contamination()'s rows."""
    ends = F.aggregate("hits", F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")))
    n_hit = F.when(F.size("hits") > 0, ends["sum"]).otherwise(0).cast("long")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with no hit word; every column as it was.

    The text never leaves its task: batches are filtered where they are read.
    """
    for block in _blocks(benchmark):
        docs = _keep_clean(docs, block, window)
    return docs


def _keep_clean(docs: DataFrame, items: list, window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index("text")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, window)
        for batch in batches:
            keep = [not matcher.match(words_of(t.encode() if (t := x.as_py()) is not None else None))[1] for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
       FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": ORACLE}
