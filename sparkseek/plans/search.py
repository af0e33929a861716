"""Search requests and their plans.

search -> exact check -> order (score, property or keys) -> pins -> distinct -> page;
facets and groups are made of the whole list, the count is taken before distinct.
Nothing runs until one of the result's tables is used.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions.scoring import Bm25
from ..operators import results as R
from ..operators import vector_search
from ..operators.bm25 import TextQuery, holds_exactly, ranked, searched
from ..operators.filters import Where, distance, geo_only
from ..schema import vector_size
from ..sources.index import Index

#: Rows of a page that is sent to all tasks; a longer one is joined as Spark sees fit.
BROADCAST_PAGE = 10_000


@dataclass
class Request:
    term: str = ""
    mode: str = "fulltext"
    properties: list[str] | str | None = None
    where: dict | None = None
    exact: bool = False
    prefix: bool = True
    tolerance: int = 0
    threshold: float = 1.0
    boost: dict[str, float] | None = None
    relevance: Bm25 = field(default_factory=Bm25)
    vector: dict | None = None
    similarity: float = vector_search.SIMILARITY
    hybrid_weights: tuple[float, float] | None = None
    facets: dict[str, dict] | None = None
    group_by: dict | None = None
    distinct_on: str | None = None
    sort_by: dict | list[Column] | None = None
    limit: int = 10
    offset: int = 0
    preflight: bool = False
    include_vectors: bool = False

    def text(self) -> TextQuery:
        return TextQuery(self.term, self.properties or "*", self.exact, self.prefix, self.tolerance, self.threshold, self.boost, self.relevance)


class Result:
    def __init__(self, index: Index, request: Request):
        self.index, self.request = index, request

    @cached_property
    def scored(self) -> DataFrame:
        """seq, score of every match."""
        ix, r = self.index, self.request
        allowed = Where(ix, r.where).apply(ix.docs).select("seq") if r.where else None
        if r.mode == "vector":
            return self._near(allowed)
        if r.mode == "hybrid":
            text = ranked(ix, r.text(), allowed) if r.term else None
            near = self._near(allowed)
            if text is None:
                text = near.where("false")
            return vector_search.hybrid(text, near, r.hybrid_weights)
        if r.mode != "fulltext":
            raise SeekError("INVALID_SEARCH_MODE", r.mode)
        if r.term or r.properties:
            found = ranked(ix, r.text(), allowed)
            if r.exact and r.term:
                searched(ix, r.properties or "*")
                found = found.join(holds_exactly(ix, ix.docs, r.text()).select("seq"), "seq", "left_semi")
            return found
        if (only := geo_only(ix, r.where)) is not None:
            return self._by_distance(*only)
        return (ix.docs if allowed is None else allowed).select("seq", F.lit(0.0).alias("score"))

    def _near(self, allowed: DataFrame | None) -> DataFrame:
        v = self.request.vector
        if not v:
            raise SeekError("INVALID_VECTOR_INPUT")
        return vector_search.near(self.index, v["property"], v["value"], self.request.similarity, allowed)

    def _by_distance(self, prop: str, how: dict) -> DataFrame:
        rows = Where(self.index, {prop: how}).apply(self.index.docs).select("seq", distance(F.col(prop), how).alias("m"))
        most = rows.agg(F.max("m").alias("most")).scalar()
        return rows.select("seq", (most - F.col("m") + 1).alias("score"))

    @cached_property
    def matches(self) -> DataFrame:
        """Every match with its document's columns."""
        return self.index.docs.join(self.scored, "seq")

    @cached_property
    def _pins(self) -> bool:
        return bool(self.index.pins) and self.request.mode != "vector" and bool(R._promotions(self.index, self.request.term))

    @cached_property
    def listed(self) -> DataFrame:
        """The matches, and the documents that pins add to them."""
        if not self._pins:
            return self.matches
        return R.pinned(self.index, self.matches, self.request.term, self._keys()).drop("slot")

    def _keys(self) -> list[Column]:
        s = self.request.sort_by
        if not s or self.request.mode != "fulltext":
            return R.order_keys()
        if isinstance(s, list):
            return [*s, *R.order_keys()]
        return R.sort_keys(self.index, s["property"], str(s.get("order", "ASC")).upper() == "DESC")

    @property
    def count(self) -> DataFrame:
        return (self.listed if self._pins else self.scored).agg(F.count("*").alias("count"))

    @property
    def hits(self) -> DataFrame:
        """The page: documents, score, and place from 0."""
        ix, r = self.index, self.request
        if r.preflight:
            return self.matches.where("false")
        keys = self._keys()
        plain = not self._pins and not r.distinct_on and not (r.sort_by and r.mode == "fulltext")
        if plain:
            # Rank on ids; documents are fetched for the page alone.
            page = self.scored.orderBy(*keys).offset(r.offset).limit(r.limit)
            small = F.broadcast(page) if r.limit <= BROADCAST_PAGE else page
            out = small.join(ix.docs, "seq")
            return self._vectors(out).orderBy(*keys)
        rows = self.matches
        if self._pins:
            rows, keys = R.pinned(ix, rows, r.term, keys), [F.asc("slot"), *keys]
        if r.distinct_on and r.mode == "fulltext":
            rows = R.distinct_on(ix, rows, r.distinct_on, keys)
        page = self._vectors(rows.orderBy(*keys).offset(r.offset).limit(r.limit))
        return page.drop("slot") if self._pins else page

    def _vectors(self, rows: DataFrame) -> DataFrame:
        if self.request.include_vectors:
            return rows
        gone = [p for p, k in self.index.schema.fields.items() if vector_size(k) and p in rows.columns]
        return rows.withColumns({p: F.lit(None).cast(rows.schema[p].dataType) for p in gone}) if gone else rows

    @property
    def facets(self) -> dict[str, DataFrame]:
        return {p: R.facet(self.index, self.listed, p, s) for p, s in (self.request.facets or {}).items()}

    @property
    def groups(self) -> DataFrame:
        g = self.request.group_by or {}
        return R.groups(self.index, self.listed, g["properties"], g.get("max_result", 0))


def search(index: Index, **request) -> Result:
    """Checks the request; hooks named before_search may change it."""
    r = Request(**request)
    for hook in index.hooks.get("before_search", []):
        r = hook(index, r) or r
    if r.mode not in ("fulltext", "vector", "hybrid"):
        raise SeekError("INVALID_SEARCH_MODE", r.mode)
    return Result(index, r)
