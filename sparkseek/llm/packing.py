"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared lengths). Pieces come longest first; of the open bins that can take a
piece under every constraint, the one with the least weighted residual norm - or
the largest weighted dot-product of the residual and the piece - gets it.

Only documents longer than a bin are cut: into whole bins, the first piece
taking what is left over. Whole pieces fill a bin by themselves, so each document
has at most one piece to pack. These are dealt at random (by a hash of their
place in the scan) to groups of about GROUP pieces, each packed in one task;
group size is fixed, so tasks stay small whatever the input, at a cost of less
than one bin in a group.

Defined results: a null text is the empty one and gives a piece with the end id
alone; repeated rows and null ids are packed as their own rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, materialize, pieces, table

TOKENS = 1024
END_ID = 2
GROUP = 8_192
#: Weights of tokens, documents and attention cost: tokens decide.
WEIGHTS = (1.0, 1e-3, 1e-3)


class Ids:
    """The ids that the tokenizers library gives for a text, plus an end id.

    Texts of letters and signs on whose classes all Unicode versions agree go
    through tiktoken with the same ranks, which is four times as fast; any other
    text, and any that spells a special token, goes to the library itself.
    """

    _PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-―‘-„…€]")

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None, end_id: int | None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.end = [] if end_id is None else [end_id]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self._PLAIN.search(text) or any(s in text for s in self.special):
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids + self.end, "<u4")


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a sequence."""
    first = length % most or min(length, most)
    return [(0, first)] + [(s, most) for s in range(first, length, most)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def tokenized_pieces(docs: DataFrame, most: int, json_path: str, ranks_path: str | None, pattern: str | None, end_id: int | None = END_ID) -> DataFrame:
    """A row a piece. place: the document's place in the scan."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(json_path, ranks_path, pattern, end_id)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = ids_of(text or "")
                for k, (start, length) in enumerate(cut(len(ids), most)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), place))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights=WEIGHTS, select: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. lengths: of pieces in the order to pack."""
    if select not in ("norm", "dot"):
        raise ValueError(f"select is norm or dot, not {select}")
    cap = np.asarray(capacity, float)
    w = np.asarray(weights, float)[:, None]
    n = len(lengths)
    shortest = np.minimum.accumulate(lengths[::-1])[::-1] if n else lengths
    left = np.empty((3, max(n, 1)))
    bins = np.empty(max(n, 1), np.int64)
    opened = used = 0
    out, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if i % 256 == 0:  # bins that no later piece can join
            keep = (left[0, :opened] >= shortest[i]) & (left[1, :opened] >= 1)
            k = int(keep.sum())
            left[:, :k], bins[:k] = left[:, :opened][:, keep], bins[:opened][keep]
            opened = k
        rest = left[:, :opened] - need[:, None]
        fits = np.flatnonzero((rest >= 0).all(axis=0))
        if len(fits):
            if select == "norm":
                score = (w * (rest[:, fits] / cap[:, None]) ** 2).sum(axis=0)
            else:
                score = -(w * (left[:, fits] / cap[:, None]) * (need / cap)[:, None]).sum(axis=0)
            at = fits[int(np.argmin(score))]
        else:
            at = opened
            left[:, at], bins[at] = cap, used
            opened, used = opened + 1, used + 1
        out[i], offsets[i] = bins[at], cap[0] - left[0, at]
        left[:, at] -= need
    return out, offsets


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokens: int, documents: int | None = None, attention: float | None = None, *, json_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int | None = END_ID, weights=WEIGHTS, select: str = "norm", group: int = GROUP) -> DataFrame:
    """Pieces with their sequence and offset.

    documents and attention bound what a sequence takes besides its tokens; left
    out, they do not bind. A whole piece is let in even where its own attention
    cost is above the bound, as it could go nowhere else.
    """
    if (documents is not None and documents < 1) or (attention is not None and attention <= 0) or tokens < 1:
        raise ValueError("a sequence has room for a token, a document and its attention at least")
    groups = pieces(docs.count(), group)
    rows = materialize(tokenized_pieces(docs, tokens, json_path, ranks_path, pattern, end_id), "pieces")
    capacity = (tokens, tokens if documents is None else documents, float(tokens) ** 2 if attention is None else attention)
    whole = rows.where(F.col("length") == tokens)
    part = F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int")
    loose = rows.where(F.col("length") < tokens).withColumn("part", part)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "place"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy()
        where, offsets = best_fit(lengths, capacity, weights, select)
        base = int(frame["part"].iloc[0]) << 32
        return frame.assign(sequence_id=-1 - (base + where), offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    packed = loose.groupBy("part").applyInPandas(run, PACKED)
    # Whole pieces get ids from 0 up, by their place in the written table; the others' ids are negative.
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionAll(alone)


def tokenizer_files() -> dict:
    import public_tokenizers as p

    return {"json_path": p.path("byte_bpe_50k.json"), "ranks_path": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENS, **tokenizer_files())


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
