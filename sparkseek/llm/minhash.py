"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A signature has CHUNKS x WIDTH values of 16 bits, one for each hash function.
Two signatures that differ in at most T = 2 * CHUNKS - 1 values differ in at most
one value of some chunk (pigeonhole), so each chunk is indexed under WIDTH keys,
one for each value left out: documents within T always share a key. At a
similarity of 0.8 the signatures differ in 19 of 96 values on average (T is 23),
and two documents fail to share any key with a chance of about 2e-4.

Whole classes of equal word sequences are one node. Candidates are confirmed on
their full shingle sets (64-bit hashes of the shingles). Groups of near copies
stay linear:

* a key offers pairs of two members only with all of its members: of the one that
  shares the most keys with others, mostly what a group was copied from, and of
  the least (of up to three members, that is all pairs);
* what these links already put into one component needs no further pair;
* the members that are left outside a key's largest component are compared with
  the rest of the key, in blocks of bounded size, and of the pairs whose parity
  sketches allow the threshold each is passed on under the first key that it shares.

Defined results: null or wordless text has an empty set and links with nothing;
a null doc_id links with nothing and is its own (null) component; rows that share
a doc_id are one node with several texts; other columns are not read. keep_first
decides by row: of a component one document stays, and of its rows of equal words one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASHES, bit_filter, components, discard, gives_back, mark, materialize, table

CHUNKS, WIDTH, SHINGLE = 12, 8, 5
#: Rows of one key that are compared at once: of those left over, of the others.
LEFT_BLOCK, RIGHT_BLOCK = 1024, 4096

#: Bits of the parity sketch: of each slot, whether an odd number of a set's
#: shingles fall into it. Two sets differ in at least as many shingles as their
#: sketches do in bits, so a pair it turns down can't be alike.
PARITY = 2048
VALUES = CHUNKS * WIDTH
#: A node's record: signature, parity sketch, set size, in units of 16 bits.
RECORD = VALUES + PARITY // 16 + 4

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            h = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = h(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], hashes: Words, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = mixed(h[:n] + np.uint64(len(words[:size])))
    for k in range(1, size):
        out = mixed(out * _MIX + h[k : k + n])
    return np.unique(out)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    n = CHUNKS * WIDTH
    odd = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    return odd[:, None], rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[None, i : i + 4096] * a
        part += b
        part ^= part >> np.uint64(31)
        np.minimum(least, part.min(axis=1), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def parity_of(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint16)


def record_of(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    size = np.array([len(shingles)], np.uint64).view(np.uint16)
    return np.concatenate([signature(shingles, a, b), parity_of(shingles), size]).tobytes()


class Records:
    """Columns of many records."""

    def __init__(self, blobs):
        r = np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, RECORD)
        self.sig = r[:, :VALUES]
        self.parity = np.ascontiguousarray(r[:, VALUES:-4]).view(np.uint64)
        self.size = np.ascontiguousarray(r[:, -4:]).view(np.uint64)[:, 0].astype(np.int64)


def may_be_alike(parity_x, parity_y, size_x, size_y, percent: int) -> np.ndarray:
    """Whether so few shingles differ as the similarity allows."""
    differ = np.bitwise_count(parity_x ^ parity_y).sum(axis=-1, dtype=np.int64)
    return differ * (100 + percent) <= (size_x + size_y) * (100 - percent)


def keys_of(sig: np.ndarray) -> np.ndarray:
    """The WIDTH keys of each chunk: (rows, CHUNKS * WIDTH) from (rows, values)."""
    chunks = sig.reshape(len(sig), CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
    place = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(WIDTH)
    for out in range(WIDTH):
        k = np.broadcast_to(mixed(place + np.uint64(out + 1)), chunks.shape[:2]).copy()
        for j in range(WIDTH):
            if j != out:
                k = mixed(k * _MIX + chunks[:, :, j])
        keys[:, :, out] = k
    return keys.reshape(len(sig), -1)


SKETCH = "doc_id long, rid long, n_shingles long, k1 long, k2 long, sig binary"


def _rid() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row a document: its own hash, set size, 128-bit hash of its words, signature."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = Words(), _multipliers()
        for batch in batches:
            size, k1, k2, sigs = [], [], [], []
            for text in batch.column(1):
                t = text.as_py()
                words = t.lower().split() if t else []
                s = shingle_set(words, hashes, shingle)
                size.append(len(s))
                d = xxhash.xxh3_128_digest(b" ".join(words))
                k1.append(int.from_bytes(d[:8], "little", signed=True))
                k2.append(int.from_bytes(d[8:], "little", signed=True))
                sigs.append(record_of(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "rid", "n_shingles", "k1", "k2", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), _rid().alias("rid")).mapInArrow(run, SKETCH)


def _index(nodes: DataFrame) -> DataFrame:
    """key, place, node: each document under its CHUNKS * WIDTH keys."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = keys_of(Records(batch.column(1).to_pylist()).sig)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            place = np.tile(np.arange(keys.shape[1], dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(place), pa.array(node)], names=["key", "place", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, place int, node long")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose records allow the similarity."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (Records(batch.column(i).to_pylist()) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(may_be_alike(x.parity, y.parity, x.size, y.size, percent)))

    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on their full sets."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last[0]:
                    last = (x, shingle_set((x or b"").lower().split(), hashes, shingle))
                s, t = last[1], shingle_set((y or b"").lower().split(), hashes, shingle)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wanted = bit_filter(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("t"))
    texts = texts.where(wanted(F.col("id")))
    left = texts.select(F.col("id").alias("a"), F.col("t").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("t").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _left_over(shared: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one key, neither a pivot, in different components."""
    marked = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = marked.groupBy("key", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.sum("m").alias("all"), F.max("m").alias("most")).where("most < all")
    rows = marked.where(~F.array_contains("pivots", F.col("node"))).join(largest, "key").join(nodes.select("node", "sig"), "node")
    out, h = F.col("component") != F.col("largest"), F.xxhash64("node")
    n_left, n_right = (F.greatest(F.ceil(F.col(n) / F.lit(k)), F.lit(1)).cast("int") for n, k in (("outside", LEFT_BLOCK), ("all", RIGHT_BLOCK)))
    rows = rows.withColumn("outside", F.col("all") - F.col("most")).select("key", "place", "node", "component", "largest", "sig", n_left.alias("nl"), n_right.alias("nr"), h.alias("h"), out.alias("out"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("out").withColumn("r", each("nr")).withColumn("l", F.pmod("h", "nl").cast("int")).withColumn("side", F.lit(0))
    right = rows.withColumn("l", each("nl")).withColumn("r", F.pmod("h", "nr").cast("int")).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("key", "l", "r", "side", "place", "node", "component", "sig", "out")
    return both.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r", "side").mapInArrow(partial(_compare, percent=percent), "a long, b long")


@gives_back
def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of sorted blocks of one key: the pairs that may be alike, under their first key."""
    for block in _runs(batches):
        side = block["side"].to_numpy()
        k = int((side == 0).sum())
        if not 0 < k < len(side):
            continue
        node, component, out = (block[c].to_numpy() for c in ("node", "component", "out"))
        r = Records(block["sig"].to_pylist())
        sig = r.sig
        place = int(block["place"][0].as_py())
        a, b = [], []
        for i in range(k):
            # Pairs of two that are outside come up twice: once is enough.
            near = np.flatnonzero((component[k:] != component[i]) & (~out[k:] | (node[k:] > node[i]))) + k
            near = near[may_be_alike(r.parity[near], r.parity[i], r.size[near], r.size[i], percent)]
            differ = sig[near] != sig[i]
            if len(near):
                chunks = differ.reshape(len(near), CHUNKS, WIDTH)
                errors = chunks.sum(axis=2)
                first = (errors <= 1).argmax(axis=1)
                at = np.arange(len(near))
                value = np.where(errors[at, first] == 1, chunks[at, first].argmax(axis=1), 0)
                near = near[first * WIDTH + value == place]
                a.append(np.minimum(node[near], node[i]))
                b.append(np.maximum(node[near], node[i]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of equal (key, l, r) from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("key", "l", "r")])
        cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for x, y in zip(edges, edges[1:], strict=False):
            here = tuple(ids[:, x])
            if here != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    return _judged(docs, shingle, percent).drop("rid", "k1", "k2")


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """near_duplicates with each row's own hash, rid, and that of its words."""
    sketch = materialize(sketches(docs, shingle), "sketches")
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig"))
    nodes = materialize(classes, "nodes")
    start = mark()
    index = materialize(_index(nodes), "index", **HASHES)
    keys = index.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    shared = materialize(index.join(keys, "key"), "shared-keys")
    few, many = shared.where("n < 4"), shared.where("n >= 4")
    # The text that a group's copies were made from shares the most keys with them.
    weight = many.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = many.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    few = few.select("key", "place", "node", "n", F.array("lo", "hi").alias("pivots"))
    many = many.join(hubs, "key").select("key", "place", "node", "n", F.array_distinct(F.array("hub", "lo")).alias("pivots"))
    shared = materialize(few.unionAll(many), "pivots")
    discard(docs.sparkSession, start, shared)
    pivot = F.explode(F.array_remove("pivots", F.col("node")))
    star = shared.select("node", pivot.alias("p")).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
    star = materialize(_near(star, nodes, percent), "star-pairs")
    links = materialize(_confirm(star, docs, shingle, percent), "links")
    labels = components(links)
    rest = materialize(_left_over(shared.where("n > 3"), labels, nodes, percent).distinct(), "rest-pairs")
    more = materialize(_confirm(rest, docs, shingle, percent), "links")
    component = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not more.isEmpty():
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        lifted = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(lifted).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        component = component.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    by_class = component.select("k1", "k2", F.col("component").alias("component_id"))
    out = some.join(by_class, ["k1", "k2"]).select("doc_id", "rid", "k1", "k2", "n_shingles", "component_id")
    lone = sketch.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "rid", "k1", "k2", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionAll(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns: that of the least doc_id,
    and of its rows of equal words one."""
    start = mark()
    found = materialize(_judged(docs, shingle, percent), "judged")
    discard(docs.sparkSession, start, found)
    linked = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    stay = linked.where("kept")
    same = ["doc_id", "k1", "k2"]
    several = stay.groupBy(*same).agg(F.min("rid").alias("least"), F.max("rid").alias("most"), F.count("*").alias("rows")).where("rows > 1")
    others = stay.join(several.where("least < most"), same).where("rid <> least").select("rid")
    gone = materialize(linked.where("NOT kept").select("rid").unionAll(others).select(F.col("rid").alias("_gone")).distinct(), "near-copies")
    twice = materialize(several.select(F.col("least").alias("_twice")), "repeated-rows")
    discard(docs.sparkSession, start, gone, twice)
    is_gone, is_twice = bit_filter(gone, "_gone"), bit_filter(twice, "_twice", 1 << 18)
    keyed = docs.withColumn("_rid", _rid())
    may, again = is_gone(F.col("_rid")), is_twice(F.col("_rid")) & F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    told = keyed.where(may | again).join(gone, F.col("_rid") == F.col("_gone"), "left_anti")
    parts = keyed.where(~may & ~again), told.where(~again), told.where(again).dropDuplicates(["_rid"])
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE unnest([w[i] || ' ' || w[i + 1] for i in generate_series(1, greatest(len(w) - 1, 1))]) END AS sh FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT doc_id, sh, row_number() OVER (PARTITION BY doc_id ORDER BY f, sh) AS r FROM (SELECT doc_id, sh, count(*) OVER (PARTITION BY sh) AS f FROM s)),
pre AS (SELECT doc_id, sh FROM rare JOIN n USING (doc_id) WHERE r <= n - ceil(n * 0.8) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.sh = b.sh AND a.doc_id < b.doc_id),
i AS (SELECT c.a, c.b, count(*) AS k FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.sh = x.sh GROUP BY c.a, c.b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.b FROM r JOIN e ON r.v = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(v)::BIGINT AS component_id, doc_id = min(v) AS kept
FROM documents JOIN r ON r.u = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n
"""

QUERIES = {"op3_minhash": op3_minhash}
ORACLES = {"op3_minhash": ORACLE}
