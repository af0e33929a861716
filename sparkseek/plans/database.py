"""A collection with its settings: the surface that applications use.

A database names a schema, an analyzer, a ranker and hooks, and holds the newest
version of an index. Changes and searches are DataFrame plans; hooks are callables
that get and may return DataFrames (rows, ids) or requests.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions.text import Analyzer
from ..operators import rankers, vector_search
from ..operators import results as R
from ..operators.filters import Where
from ..operators.suggest import suggest
from ..schema import SearchSchema
from ..sources.index import Index, ordered
from ..sources.store import compact
from .search import Request, Result

HOOKS = tuple(f"{when}_{what}{many}" for what in ("insert", "remove", "update", "upsert") for many in ("", "_multiple") for when in ("before", "after")) + (
    "before_search", "after_search", "before_load", "after_load", "after_create",
)
COMPONENTS = ("analyzer", "ranker", "sorter", "validate_schema", "format_elapsed")
RANKERS = ("bm25", "sentences", "positions")


@dataclass
class Plugin:
    """A name, hooks, and components that take the place of the built-in ones."""

    name: str
    hooks: dict[str, Callable] = field(default_factory=dict)
    components: dict[str, object] = field(default_factory=dict)


def format_nanoseconds(n: int) -> str:
    """12ns, 3μs, 45ms or 6s."""
    for size, unit in ((1_000_000_000, "s"), (1_000_000, "ms"), (1_000, "μs")):
        if n >= size:
            return f"{n // size}{unit}"
    return f"{n}ns"


class Database:
    def __init__(self, index: Index, ranker: str = "bm25", sort: bool = True, unsortable: tuple[str, ...] = (), plugins: tuple[Plugin, ...] = ()):
        self.index, self.ranker, self.sort, self.unsortable = index, ranker, sort, frozenset(unsortable)
        self.hooks: dict[str, list[Callable]] = {}
        self.format_elapsed: Callable[[int], str] = format_nanoseconds
        self.sorter: Callable | None = None
        self._plug(plugins)
        if self.ranker not in RANKERS and not callable(self.ranker):
            raise SeekError("UNSUPPORTED_COMPONENT", ranker)
        self._run("after_create", self)

    @classmethod
    def create(cls, docs: DataFrame, schema: dict | None = None, analyzer: Analyzer | None = None, exclude: tuple[str, ...] = (), order: tuple[str, ...] = ("id",), plugins: tuple[Plugin, ...] = (), vector_indexes: dict[str, object] | None = None, **settings) -> Database:
        """docs: with seq or, without it, numbered by `order`."""
        own = [p.components["analyzer"] for p in plugins if "analyzer" in p.components]
        if len(own) + (analyzer is not None) > 1:
            raise SeekError("PLUGIN_COMPONENT_CONFLICT", "analyzer")
        if "seq" not in docs.columns:
            docs = ordered(docs, *order)
        unknown = [p for p in exclude if p not in docs.columns]
        if unknown:
            raise SeekError("INVALID_STORE_CONFIG", unknown)
        return cls(Index.build(docs, schema, own[0] if own else analyzer, exclude, vector_indexes=vector_indexes), plugins=plugins, **settings)

    def _plug(self, plugins: tuple[Plugin, ...]) -> None:
        taken: dict[str, str] = {}
        for p in plugins:
            for name, what in p.components.items():
                if name not in COMPONENTS:
                    raise SeekError("UNSUPPORTED_COMPONENT", name)
                if name in taken:
                    raise SeekError("PLUGIN_COMPONENT_CONFLICT", f"{name}: {taken[name]}, {p.name}")
                taken[name] = p.name
                if name == "validate_schema":
                    bad = what(self.index.schema, self.index.docs)
                    if bad:
                        raise SeekError("SCHEMA_VALIDATION_FAILURE", bad)
                elif name != "analyzer":
                    setattr(self, name, what)
            for name, hook in p.hooks.items():
                self.add_hook(name, hook)

    def add_hook(self, name: str, hook: Callable) -> None:
        if name not in HOOKS:
            raise SeekError("UNSUPPORTED_COMPONENT", name)
        self.hooks.setdefault(name, []).append(hook)

    def _run(self, name: str, value):
        for hook in self.hooks.get(name, []):
            value = hook(self, value) or value
        return value

    # -- documents -----------------------------------------------------------------------

    @property
    def schema(self) -> SearchSchema:
        return self.index.schema

    def count(self) -> int:
        return self.index.n_docs

    def get(self, doc_id: str) -> DataFrame:
        return self.index.get(doc_id)

    def refit(self, prop: str) -> Database:
        """Centroids and codes of a vector index, made anew from the documents of now."""
        vector_search.refit(self.index, prop)
        return self

    def get_many(self, ids: list[str]) -> DataFrame:
        wanted = self.index.spark.createDataFrame([(i,) for i in ids], "id string")
        # Spark broadcasts a list of ids as long as it is small.
        return self.index.docs.join(wanted, "id", "left_semi")

    def _change(self, what: str, rows, do: Callable[[Index, object], Index]) -> Database:
        # A hook of one document and a hook of many see the same rows: here a row is a batch.
        for suffix in ("", "_multiple"):
            rows = self._run(f"before_{what}{suffix}", rows)
        self.index = do(self.index, rows)
        for suffix in ("", "_multiple"):
            self._run(f"after_{what}{suffix}", rows)
        return self

    def insert(self, rows: DataFrame) -> Database:
        return self._change("insert", rows, Index.insert)

    def remove(self, ids: DataFrame | list[str]) -> Database:
        return self._change("remove", ids, Index.remove)

    def upsert(self, rows: DataFrame) -> Database:
        return self._change("upsert", rows, Index.upsert)

    def update(self, ids: DataFrame | list[str], rows: DataFrame) -> Database:
        """Rows in place of documents; ids that aren't there are no error."""
        return self._change("update", rows, lambda index, new: index.remove(ids).insert(new))

    # -- searches ------------------------------------------------------------------------

    def search(self, **request) -> Result:
        began = time.perf_counter_ns()
        r = self._run("before_search", Request(**request))
        self._sortable(r)
        index = self.index
        out = Result(index, r)
        if self.ranker != "bm25" and r.mode == "fulltext" and (r.term or r.properties):
            out.scored = self._scored(index, r)
        if self.sorter and r.sort_by:
            out = Result(index, replace(r, sort_by=self.sorter(index, r.sort_by)))
        out.elapsed = self.format_elapsed(time.perf_counter_ns() - began)
        return self._run("after_search", out)

    def _sortable(self, r: Request) -> None:
        if isinstance(r.sort_by, dict):
            if not self.sort:
                raise SeekError("SORT_DISABLED")
            if r.sort_by["property"] in self.unsortable:
                raise SeekError("UNABLE_TO_SORT_ON_UNKNOWN_FIELD", r.sort_by["property"])

    def _scored(self, index: Index, r: Request) -> DataFrame:
        props = index.schema.strings() if r.properties in (None, "*") else list(r.properties)
        if callable(self.ranker):
            found = self.ranker(index, r)
        elif self.ranker == "sentences":
            found = rankers.by_sentences(index, r.term, props, r.exact, r.tolerance, r.boost)
        else:
            found = rankers.by_position(index, r.term, props, r.boost)
        if not r.where:
            return found
        return found.join(Where(index, r.where).apply(index.docs).select("seq"), "seq", "left_semi")

    def suggest(self, term: str, **how) -> DataFrame:
        if self.ranker != "bm25":
            raise SeekError("SUGGEST_NOT_SUPPORTED", self.ranker)
        where = how.pop("where", None)
        if where:
            how["allowed"] = Where(self.index, where).apply(self.index.docs).select("seq")
        return suggest(self.index, term, **how)

    # -- pins ----------------------------------------------------------------------------

    def insert_pin(self, rule: dict) -> None:
        if rule["id"] in self.index.pins:
            raise ValueError(f"there is a pin {rule['id']}")
        self.index.pins[rule["id"]] = rule

    def update_pin(self, rule: dict) -> None:
        if rule["id"] not in self.index.pins:
            raise ValueError(f"there is no pin {rule['id']}")
        self.index.pins[rule["id"]] = rule

    def delete_pin(self, rule_id: str) -> bool:
        return self.index.pins.pop(rule_id, None) is not None

    def get_pin(self, rule_id: str) -> dict | None:
        return self.index.pins.get(rule_id)

    def all_pins(self) -> list[dict]:
        return list(self.index.pins.values())

    # -- storage -------------------------------------------------------------------------

    def save(self, path: str) -> None:
        self.index.save(path)

    @classmethod
    def load(cls, spark, path: str, analyzer: Analyzer | None = None, **settings) -> Database:
        return cls(Index.load(spark, path, analyzer), **settings)

    def freeze(self, path: str) -> Database:
        """Rewrite the index as sorted tables without what changes left behind."""
        if self.ranker != "bm25":
            raise SeekError("FREEZE_NOT_SUPPORTED", self.ranker)
        self.index = compact(self.index, path)
        return self

    def facets_of(self, rows: DataFrame, prop: str, spec: dict | None = None) -> DataFrame:
        return R.facet(self.index, rows, prop, spec)

    def searchable(self) -> dict[str, str]:
        return self.schema.searchable()

    def sortable(self) -> dict[str, str]:
        return {p: k for p, k in self.schema.sortable().items() if p not in self.unsortable} if self.sort else {}
