"""Token counts with a two-tier table of pre-token lengths, all on the map side.

The tokenizer's pieces never span the end of a word (none has the space mark
after another character; __init__ checks that), so a text's count is the sum of
its pre-tokens' counts: runs of spaces with the word that follows. Tier one is a
table of frequent pre-tokens, broadcast as two flat buffers; tier two is a cache
in each worker, filled by encoding what tier one lacks. No pre-token of the
corpus is shuffled. Tier one is only a store of answers: it is fitted on a
bounded sample (SAMPLE_DOCS documents, FREQUENT entries) and its content cannot
change a count.

Defined results: null counts as the empty text (0 bytes, 0 tokens); repeated
rows and null ids each give their row; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, table

LIMIT = 4096
SAMPLE_DOCS = 4096
FREQUENT = 32_768
#: Entries of a worker's cache and the longest pre-token that it keeps.
CACHE, LONGEST = 300_000, 64

MARK = "▁"
_RUNS = re.compile(r" *[^ ]+| +")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    """What is encoded on its own; the encoder puts back the first space."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [x[1:] for x in _RUNS.findall(" " + text)]


class Encoder:
    """Length of a pre-token: from tier one, the cache, or by encoding it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this tokenizer spans words")

        # A lone space before another pre-token: there is no text that gives it alone.
        self.space = len(self.model.encode("x ")) - len(self.model.encode("x"))

    def length(self, pre_token: str) -> int:
        return len(self.model.encode(pre_token)) if pre_token else self.space


class Lengths(dict):
    """Tier two under tier one: a bounded cache that encodes what it lacks."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.encoder, self.first, self.most = Encoder(path), frequent, len(frequent) + CACHE

    def __missing__(self, pre_token: str) -> int:
        n = self.encoder.length(pre_token)
        if len(pre_token) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.first)
            self[pre_token] = n
        return n


def pack_table(entries: list[tuple[str, int]]) -> tuple[bytes, bytes, bytes]:
    """Keys end to end, their lengths in bytes, their token counts."""
    keys = [k.encode() for k, _ in entries]
    return b"".join(keys), np.array([len(k) for k in keys], np.uint16).tobytes(), np.array([n for _, n in entries], np.uint16).tobytes()


def unpack_table(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    keys, sizes, counts = packed[0], np.frombuffer(packed[1], np.uint16), np.frombuffer(packed[2], np.uint16)
    ends = np.cumsum(sizes, dtype=np.int64)
    return {keys[e - s : e].decode(): int(n) for e, s, n in zip(ends.tolist(), sizes.tolist(), counts, strict=True)}


def frequent_table(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = FREQUENT) -> tuple[bytes, bytes, bytes]:
    """The most frequent pre-tokens of a sample, with their token counts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for f in frames:
            for t in f["text"]:
                seen.update(x for x in pre_tokens(t) if x and len(x) <= LONGEST)
        top = seen.most_common(entries)
        if top:
            yield pd.DataFrame({"p": [k for k, _ in top], "n": [n for _, n in top]})

    rows = docs.count()
    part = docs.select("text").dropna().sample(False, min(1.0, sample_docs / max(rows, 1)), 11)
    top = part.mapInPandas(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(entries)
    encoder = Encoder(path)
    return pack_table([(r["p"], encoder.length(r["p"])) for r in top.collect()])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs."""
    path = path or tokenizer_path()
    sent = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, sample_docs))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, unpack_table(sent.value))
        get = lengths.__getitem__
        for batch in batches:
            n = [sum(map(get, pre_tokens(t))) if (t := x.as_py()) else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select(F.col("doc_id").cast("long"), "text", size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
