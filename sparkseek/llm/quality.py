"""Quality classifier: a modified Kneser-Ney model of trusted text.

One interpolated model of ORDER code points a language is trained on the trusted
documents (labelled good and not toxic), all but those held out. Code points are
taken as they are, of any script; the model has no fixed vocabulary or size and
grows with the trusted text.

Training is counting and joining: n-grams are counted in shards by (language,
n-gram), and discounts, continuation counts and back-off weights are aggregates of
these counts, joined to them order by order. Scoring joins with the model too. Of a
code point w after the context u (one code point shorter than the order)

    log p(w | u) = log b(u) + t(u w) + log p(w | u without its first code point)

where b is a context's back-off weight and t what a seen n-gram adds to backing off;
log b and t are 0 for what was not seen. So

1. each task looks n-grams up in a table of the HOT most frequent ones, which has
   their whole log p and is broadcast (its size is fixed, and it has no bearing on a
   result), and backs off where it does not find one;
2. what it did not find it asks the model's shards for, all documents of a task
   together: blobs of sorted n-grams, the documents they are for, and counts;
3. each shard is read once, beside the blobs that ask it, which stream past it; so
   neither the documents nor what they ask meet in memory, however often an n-gram
   is asked for. Sums go back to the tasks' groups of documents.

A document is kept if its perplexity (per code point) is not above the QUANTILE of
those of the held-out trusted documents of its language: one text of HELD_OUT, by
hash, that the model has not seen.

Defined results: a null or empty text has no perplexity and is kept, and so is a
document in a language without trusted text, or with none held out; a null language
is that of empty name; labels that contradict each other are not trusted; repeated
documents are scored and counted each; other columns are not read. N-grams are told
apart by 64 bits of hash, by 48 of them in the shards. The table has to come from
files (a lost task must meet its rows in the same order again).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, discard, gives_back, mark, materialize, pieces, table

ORDER = 5
QUANTILE = 0.98
#: One trusted text of so many is not trained on.
HELD_OUT = 10
#: Code points there are: what a code point never seen shares with all others.
CLASSES = 0x110000
#: Most entries of the table that is broadcast: 12 bytes each, four slots an entry.
HOT = 1 << 18
#: Code points that are worked on at once, n-grams a task gathers to be asked for, and
#: to be counted, n-grams a shard, documents that ask it (unless a task would ask each
#: for less than 256 n-grams).
CHUNK, GATHERED, COUNTED, SHARD, ASKING = 1 << 17, 1 << 19, 1 << 18, 1 << 17, 1 << 12
#: Noncharacters: no text has them for text.
START, END = "\ufdd0", "\ufdd1"

_BACK = np.uint64(0xD1B54A32D192ED03)
_GROUP = 1 << 16


def _mix(a: np.ndarray, b) -> np.ndarray:
    z = (a ^ (b + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(29)
    return z


def _seed(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at once, as texts take more room in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _keys(codes: np.ndarray, seeds) -> list[np.ndarray]:
    """For k = 1 to ORDER, 64 bits for the k-gram that ends at each place. The first
    k - 1 places have none of their own."""
    z = [_mix(np.full(len(codes), seeds, np.uint64), codes.astype(np.uint64))]
    for k in range(1, ORDER):
        longer = z[-1].copy()
        longer[k:] = _mix(z[-1][k:], codes[: len(codes) - k].astype(np.uint64))
        z.append(longer)
    return z


def _chunks(docs: list[tuple[int, int, str]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(code points, document, seed, places of what is to be predicted) of documents
    (number, seed, text); long texts come in parts."""
    before = ORDER - 1
    parts: list[tuple[int, int, str]] = []
    size = 0

    def made():
        lengths = [len(p) for _, _, p in parts]
        codes = _codes("".join(p for _, _, p in parts))
        numbers, seeds = (np.repeat(np.array([p[i] for p in parts], t), lengths) for i, t in ((0, np.int64), (1, np.uint64)))
        own = np.ones(len(codes), bool)
        starts = np.cumsum([0, *lengths[:-1]])
        own[(starts[:, None] + np.arange(before)).ravel()] = False
        return codes, numbers, seeds, np.flatnonzero(own)

    for number, seed, text in docs:
        padded = START * before + text + END
        for at in range(0, len(text) + 1, CHUNK):
            part = padded[at : at + CHUNK + before]
            parts.append((number, seed, part))
            size += len(part)
            if size >= CHUNK:
                yield made()
                parts, size = [], 0
    if parts:
        yield made()


# -- training ------------------------------------------------------------------------------


def _counts(trusted: DataFrame) -> DataFrame:
    """lang, g, n: n-grams of the highest order, summed up within tasks as far as
    memory allows."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        got: list[tuple[np.ndarray, ...]] = []

        def summed() -> None:
            keys, codes, lang, n = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            got[:] = [(keys[order][first], codes[order][first], lang[order][first], np.add.reduceat(n[order], first))]

        def rows() -> Iterator[pa.RecordBatch]:
            if got:
                summed()
                _, codes, lang, n = got[0]
                text = codes.tobytes().decode("utf-32-le")
                grams = pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string())
                names = pa.array(list(langs), pa.string()).take(pa.array(lang))
                yield pa.RecordBatch.from_arrays([names, grams, pa.array(n)], names=["lang", "g", "n"])
            got.clear()

        for batch in _slices(batches):
            docs = [(langs.setdefault(x, len(langs)), _seed(x), t) for x, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            for codes, lang, seeds, own in _chunks(docs):
                z = _keys(codes, seeds)[-1][own]
                keys, at, n = np.unique(z, return_index=True, return_counts=True)
                at = own[at]
                got.append((keys, codes[at[:, None] + np.arange(1 - ORDER, 1)], lang[at].astype(np.int32), n))
                if sum(len(x[0]) for x in got) > 2 * COUNTED:
                    summed()
                    if len(got[0][0]) > COUNTED:
                        yield from rows()
        yield from rows()

    return trusted.select("lang", "text").mapInArrow(run, "lang string, g string, n long")


def _discounts(grams: DataFrame) -> DataFrame:
    """k, lang, d1, d2, d3: the modified discounts of each order k."""
    c = [F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)]
    t = grams.groupBy("k", "lang").agg(*c)
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    # Where counts of counts are missing (little text), the usual 0.5, 1, 1.5.
    d = [F.when((F.col(f"t{k}") > 0) & (F.col(f"t{k + 1}") > 0) & (F.col("t1") > 0), k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}")) for k in (1, 2, 3)]
    clean = [F.least(F.greatest(F.coalesce(x, F.lit(k / 2)), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)]
    return t.select("k", "lang", *clean)


def train(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, lang, g, back, whole, more, n: n-grams with their log p and what they add to
    backing off, and contexts with the log of their back-off weight as both; lang, p0:
    the log probability of an unseen code point)."""
    counted = _counts(trusted).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    grams = {ORDER: materialize(counted, "grams")}
    for k in range(ORDER - 1, 0, -1):
        # Lower orders count in how many contexts an n-gram was seen.
        shorter = grams[k + 1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n"))
        grams[k] = materialize(shorter, "grams")
    every = [g.select(F.lit(k).alias("k"), "lang", "n") for k, g in grams.items()]
    for g in every[1:]:
        every[0] = every[0].unionAll(g)
    discounts = materialize(_discounts(every[0]), "discounts")
    out: DataFrame | None = None
    for k in range(1, ORDER + 1):
        # One row a language.
        g = grams[k].join(F.broadcast(discounts.where(F.col("k") == k).drop("k")), "lang")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        g = g.select("lang", "g", "n", F.substring("g", 1, k - 1).alias("context"), F.substring("g", 2, k - 1).alias("rest"), F.least(d, F.col("n").cast("double")).alias("d"))
        by = ["lang", "context"]
        totals = materialize(g.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("d").alias("given"), F.count("*").alias("kinds")), "contexts")
        back = totals.select(*by, "total", "kinds", (F.col("given") / F.col("total")).alias("b"))
        of = back.select(*by, "total", "b")
        if k == 1:
            # One row a language.
            own, base = g.join(F.broadcast(of), by), back.select("lang", F.log(F.col("b") / CLASSES).alias("p0"))
            low = F.col("b") / CLASSES
        else:
            own, low = g.join(of, by).join(lower, ["lang", "rest"]), F.col("b") * F.col("lower")
            contexts = back.select(F.lit(k - 1).alias("k"), "lang", F.col("context").alias("g"), F.lit(True).alias("back"), F.log("b").alias("whole"), F.log("b").alias("more"), F.col("kinds").alias("n"))
            out = out.unionAll(contexts)
        seen = (F.col("n") - F.col("d")) / F.col("total")
        p = materialize(own.select("lang", "g", "n", (seen + low).alias("p"), F.log1p(seen / low).alias("more")), "probabilities")
        lower = p.select("lang", F.col("g").alias("rest"), F.col("p").alias("lower"))
        p = p.select(F.lit(k).alias("k"), "lang", "g", F.lit(False).alias("back"), F.log("p").alias("whole"), "more", "n")
        out = p if out is None else out.unionAll(p)
    return out, base


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"], F.lit(""))


def _rid(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), _lang(docs), docs["text"])


def _held(docs: DataFrame) -> Column:
    return F.pmod(F.xxhash64(docs["text"]), F.lit(HELD_OUT)) == 0


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, text of the documents to train on."""
    good = trusted_ids(labels)
    maybe = bit_filter(good, "trusted_id")
    d = docs.where(~_held(docs)).select(F.col("doc_id").cast("long"), _lang(docs).alias("lang"), "text").where("text <> ''").where(maybe(F.col("doc_id")))
    # By a shuffle of the few texts at any size: which texts are trusted has no bound.
    return d.join(good.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi").select("lang", "text")


def trusted_ids(labels: DataFrame) -> DataFrame:
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("trusted_id"))
    return one.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0").select("trusted_id")


# -- scoring -------------------------------------------------------------------------------


class _Table:
    """Values by key in open slots: for arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.steps = np.uint64(size - 1), 1
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.float32)
        left, step = np.flatnonzero(keys), 0
        while len(left):
            slot = (keys[left] + np.uint64(step)) & self.mask
            free = self.keys[slot] == 0
            _, one = np.unique(slot, return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.values[slot[one]] = keys[left[one]], values[left[one]]
            left, step = np.delete(left, one), step + 1
            self.steps = max(self.steps, step)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values or 0, whether there is one)"""
        slot = keys & self.mask
        found = self.keys[slot] == keys
        values = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (self.keys[slot] != 0))
        for step in range(1, self.steps):
            if not len(left):
                break
            slot = (keys[left] + np.uint64(step)) & self.mask
            hit = self.keys[slot] == keys[left]
            values[left[hit]], found[left[hit]] = self.values[slot[hit]], True
            left = left[~hit & (self.keys[slot] != 0)]
        return values, found


def _gram_keys(lang: list[str], grams: list[str], back: np.ndarray) -> np.ndarray:
    """The keys of n-grams of one order."""
    k, seeds = len(grams[0]), {x: _seed(x) for x in set(lang)}
    codes = _codes("".join(grams)).reshape(-1, k)
    z = np.array([seeds[x] for x in lang], np.uint64)
    for i in range(k - 1, -1, -1):
        z = _mix(z, codes[:, i].astype(np.uint64))
    return np.where(back, z ^ _BACK, z)


def _all_keys(k: np.ndarray, lang: list[str], grams: list[str], back: np.ndarray) -> np.ndarray:
    out = np.empty(len(k), np.uint64)
    for one in np.unique(k):
        at = np.flatnonzero(k == one)
        out[at] = _gram_keys([lang[i] for i in at], [grams[i] for i in at], back[at])
    return out


def _columns(batch) -> tuple:
    return batch["k"].to_numpy(), batch["lang"].to_pylist(), batch["g"].to_pylist(), np.array(batch["back"].to_pylist(), bool)


def _shard(key, shards: int):
    """Of 48 bits of key: ranges of one size."""
    return (key * np.uint64(shards)) >> np.uint64(48)


def _sharded(model: DataFrame, shards: int) -> DataFrame:
    """shard, kind 0, keys in order and values."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = _all_keys(*_columns(batch)) >> np.uint64(16)
                yield pa.RecordBatch.from_arrays([pa.array(_shard(key, shards).astype(np.int32)), pa.array(key.astype(np.int64)), batch.column("more").cast(pa.float32())], names=["shard", "key", "value"])

    keyed = model.select("k", "lang", "g", "back", "more").mapInArrow(run, "shard int, key long, value float")
    rows = keyed.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("rows"))
    none = lambda t: F.lit(None).cast(t)
    return rows.select("shard", F.lit(0).alias("kind"), none("long").alias("fid"), none("binary").alias("body"), F.col("rows.key").alias("keys"), F.col("rows.value").alias("values"))


_ASKED = "shard int, kind int, fid long, body binary, keys array<long>, values array<float>"
_ASKED_TYPES = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("fid", pa.int64()), ("body", pa.binary()), ("keys", pa.list_(pa.int64())), ("values", pa.list_(pa.float32()))])
_META = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("rid", pa.int64()), ("held", pa.bool_()), ("total", pa.int64()), ("sum", pa.float64())])


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of numbers by their bytes' places, so that small ones take little."""
    planes = [np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for x, width in columns]
    return len(columns[0][0]).to_bytes(4, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(body: bytes, *widths: int) -> list[np.ndarray]:
    n, out, at = int.from_bytes(body[:4], "little"), [], 0
    planes = np.frombuffer(pa.decompress(body[4:], decompressed_size=n * sum(widths), codec="zstd"), np.uint8)
    for width in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = planes[at : at + n * width].reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += n * width
    return out


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sums of their counts."""
    keys, n = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.uint64, np.int64), zip(*parts, strict=True) if parts else ((), ()), strict=True))
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))[: len(keys)]
    return keys[order][first], np.add.reduceat(n[order], first) if len(keys) else n


class _Group:
    """Documents of a task that ask together."""

    def __init__(self, base: dict[str, float], hot: _Table, shards: int):
        self.base, self.hot, self.shards = base, hot, shards
        self.task, self.number = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        self.clear()

    def clear(self) -> None:
        self.meta: list[tuple] = []
        self.sums, self.asked, self.waiting, self.size, self.pairs = np.zeros(_GROUP), [], [], 0, 0

    def add(self, doc_id: int | None, lang: str, text: str | None, rid: int, held: bool | None) -> None:
        scored = bool(text) and lang in self.base
        if scored:
            self.waiting.append((len(self.meta), _seed(lang), text))
            self.size += len(text)
        self.meta.append((doc_id, lang, rid, held, len(text) + 1 if scored else 0))
        if self.size >= CHUNK:
            self.work()

    def work(self) -> None:
        base = np.array([self.base.get(m[1], 0.0) for m in self.meta])
        for codes, number, seeds, live in _chunks(self.waiting):
            z = _keys(codes, seeds)

            def take(keys: np.ndarray, at: np.ndarray, number=number) -> np.ndarray:
                """Add up what is known of n-grams that end at places; ask for the
                others, and say which."""
                values, found = self.hot.get(keys)
                doc = number[at]
                self.sums += np.bincount(doc, values, _GROUP)
                asked = (keys[~found] & ~np.uint64(0xFFFF)) | doc[~found].astype(np.uint64)
                self.asked.append((asked, np.ones(len(asked), np.int64)))
                return ~found

            for k in range(ORDER, 0, -1):
                live = live[take(z[k - 1][live], live)]
                if k > 1:
                    take(z[k - 2][live - 1] ^ _BACK, live)
            lowest = number[live]
            self.sums += np.bincount(lowest, base[lowest], _GROUP)
            self.pairs = sum(len(x) for x, _ in self.asked)
            if self.pairs > 4 * GATHERED:
                # One very long document.
                self.asked = [_counted(self.asked)]
        self.waiting, self.size = [], 0

    def full(self) -> bool:
        return len(self.meta) >= _GROUP or self.pairs >= GATHERED

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is asked of each shard, and the documents themselves."""
        self.work()
        if not self.meta:
            return
        fid = (self.task << 32) | self.number
        self.number += 1
        asked, n = _counted(self.asked)
        keys, docs = asked >> np.uint64(16), asked & np.uint64(0xFFFF)
        shard = _shard(keys, self.shards)
        ends = np.flatnonzero(np.append(np.diff(shard) != 0, True))[: len(shard)] + 1
        out = []
        for a, b in zip(np.append(0, ends), ends, strict=False):
            out.append((int(shard[a]), 1, _pack((np.diff(keys[a:b], prepend=np.uint64(0)), 6), (docs[a:b], 2), (n[a:b], 4))))
        sink = pa.BufferOutputStream()
        meta = [*zip(*self.meta, strict=True), self.sums[: len(self.meta)]]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(meta, _META.types, strict=True)], schema=_META)
        with pa.ipc.new_stream(sink, _META, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_batch(batch)
        # Not of a shard, so anywhere.
        out.append((-1 - fid % 1021, 2, sink.getvalue().to_pybytes()))
        self.clear()
        for s, kind, body in out:
            yield pa.RecordBatch.from_pylist([{"shard": s, "kind": kind, "fid": fid, "body": body, "keys": None, "values": None}], schema=_ASKED_TYPES)


def _asked(rows: DataFrame, sent, shards: int) -> DataFrame:
    """What groups of documents ask of shards (kind 1), and what they are (kind 2)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(*sent.value, shards)
        for batch in _slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group.add(*row)
                if group.full():
                    yield from group.rows()
        yield from group.rows()

    return rows.mapInArrow(run, _ASKED)


def _told(both: DataFrame) -> DataFrame:
    """fid, kind, shard, body: the shards' sums for the documents of a group."""
    types = pa.schema([("fid", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by shard, the model's first.
        mine, keys, values = None, np.empty(0, np.uint64), np.empty(0)
        for batch in batches:
            out = []
            for i, (shard, kind, fid) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if kind == 0:
                    mine = shard
                    keys, values = batch.column(4)[i].values.to_numpy().view(np.uint64), batch.column(5)[i].values.to_numpy().astype(np.float64)
                    continue
                body = batch.column(3)[i].as_py()
                if kind == 1:
                    if shard != mine or not len(keys):
                        continue
                    gaps, docs, n = _unpack(body, 6, 2, 4)
                    wanted = np.cumsum(gaps, dtype=np.uint64)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    sums = np.bincount(docs.astype(np.int64), np.where(keys[at] == wanted, values[at], 0.0) * n)
                    some = np.flatnonzero(sums)
                    body = _pack((some, 2), (sums[some].astype(np.float32).view(np.uint32), 4))
                out.append({"fid": fid, "kind": kind, "shard": shard, "body": body})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)

    return both.mapInArrow(run, "fid long, kind int, shard int, body binary")


def _summed(told: DataFrame) -> DataFrame:
    """doc_id, lang, rid, held, perplexity: a row for each document."""
    # A group asks for a bounded number of n-grams (but for the last document's).
    groups = told.groupBy("fid").agg(F.max(F.when(F.col("kind") == 2, F.col("body"))).alias("meta"), F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("shard", "body")))).alias("sums"))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for meta, sums in zip(batch.column(0), batch.column(1), strict=True):
                docs = pa.ipc.open_stream(meta.as_py()).read_all()
                total, s = docs["total"].to_numpy(), docs["sum"].to_numpy().copy()
                for body in sums.values.field("body").to_pylist():
                    at, more = _unpack(body, 2, 4)
                    s[at.astype(np.int64)] += more.astype(np.uint32).view(np.float32)
                perplexity = np.exp(np.minimum(-s / np.maximum(total, 1), 700.0))
                docs = docs.drop_columns(["total", "sum"]).append_column("perplexity", pa.array(perplexity, mask=total == 0))
                yield from docs.to_batches()

    return groups.select("meta", "sums").mapInArrow(run, "doc_id long, lang string, rid long, held boolean, perplexity double")


def _hot(model: DataFrame) -> tuple[_Table, DataFrame, int]:
    """(the most frequent n-grams and contexts, the others, how many these are): by
    steps of frequency, as many whole steps as fit."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["step"]: r["count"] for r in model.groupBy(step.alias("step")).count().collect()}
    least, room = max(sizes, default=0) + 1, HOT
    while sizes and least > min(sizes) and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    hot = model.where(step >= least).select("k", "lang", "g", "back", "whole").toArrow().combine_chunks()
    keys = _all_keys(*_columns(hot)) if hot.num_rows else np.empty(0, np.uint64)
    return _Table(keys, hot["whole"].to_numpy().astype(np.float32)), model.where(step < least), sum(n for k, n in sizes.items() if k < least)


class Classifier:
    """Model and thresholds, fitted on the trusted documents of docs."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE):
        spark, start = docs.sparkSession, mark()
        model, base = train(trusted_text(docs, labels))
        p0 = {r["lang"]: r["p0"] for r in base.toLocalIterator()}
        model = materialize(model, "language-models")
        discard(spark, start, model)  # and the shuffle files of training
        hot, rest, n = _hot(model)
        # As many as the model needs, or more for what many documents ask.
        shards = max(pieces(n, SHARD), min(pieces(docs.count(), ASKING), GATHERED >> 8))
        sent = spark.sparkContext.broadcast((p0, hot))
        rows = docs.select(F.col("doc_id").cast("long"), _lang(docs).alias("lang"), "text", _rid(docs).alias("rid"), _held(docs).alias("held"))
        both = _asked(rows, sent, shards).unionByName(_sharded(rest, shards))
        told = _told(both.repartition("shard").sortWithinPartitions("shard", "kind"))
        self.scores = materialize(_summed(told), "perplexities")
        discard(spark, start, self.scores)
        known = self.scores.where("held AND perplexity IS NOT NULL").join(trusted_ids(labels), F.col("doc_id") == F.col("trusted_id"), "left_semi")
        # One row a language.
        self.thresholds = known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))

    def _judged(self) -> DataFrame:
        # A row for each language that has trusted text.
        out = self.scores.join(F.broadcast(self.thresholds), "lang", "left")
        return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))

    def judged(self) -> DataFrame:
        """doc_id, lang, perplexity, threshold, kept."""
        return self._judged().select("doc_id", "lang", "perplexity", "threshold", "kept")

    def accepted(self, docs: DataFrame) -> DataFrame:
        """The documents kept, with all their columns."""
        gone = materialize(self._judged().where("NOT kept").select(F.col("rid").alias("_rid")).distinct(), "rejected")
        maybe = bit_filter(gone, "_rid")
        keyed = docs.withColumn("_rid", _rid(docs))
        told = keyed.where(maybe(F.col("_rid"))).join(gone, "_rid", "left_anti")
        return keyed.where(~maybe(F.col("_rid"))).select(*docs.columns).unionAll(told.select(*docs.columns))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).judged()


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
