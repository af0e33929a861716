"""Search schemas: declared, inferred from a DataFrame, or both."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SeekError

SCALARS = ("string", "number", "boolean", "enum", "geopoint")
ARRAYS = ("string[]", "number[]", "boolean[]", "enum[]")
RESERVED = frozenset(["__vector", "__proto__", "seq"])
_VECTOR = re.compile(r"vector\[(\d+)\]")


def vector_size(kind: str) -> int | None:
    m = _VECTOR.fullmatch(kind)
    return int(m[1]) if m else None


@dataclass
class SearchSchema:
    """fields: dotted path -> kind."""

    fields: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, spec: dict, prefix: str = "") -> SearchSchema:
        out: dict[str, str] = {}
        for name, kind in spec.items():
            if name in RESERVED or name == "id" and not prefix:
                if name == "id":
                    continue
                raise SeekError("RESERVED_SCHEMA_PROPERTY", name)
            path = f"{prefix}{name}"
            if isinstance(kind, dict):
                out |= cls.parse(kind, f"{path}.").fields
            elif kind in SCALARS or kind in ARRAYS or (vector_size(kind) or 0) > 0:
                out[path] = kind
            else:
                raise SeekError("INVALID_SCHEMA_TYPE", f"{path}: {kind}")
        for path in out:
            if any(other.startswith(f"{path}.") for other in out):
                raise SeekError("SCHEMA_VALIDATION_FAILURE", path)
        return cls(out)

    @classmethod
    def infer(cls, df: DataFrame, declared: dict | None = None) -> SearchSchema:
        """Declared fields win; vectors are never inferred."""
        known = cls.parse(declared or {}).fields
        found: dict[str, str] = {}

        def walk(struct: T.StructType, prefix: str) -> None:
            for f in struct.fields:
                path = f"{prefix}{f.name}"
                if path == "id" or f.name in RESERVED or path in known:
                    continue
                if isinstance(f.dataType, T.StructType) and {x.name for x in f.dataType.fields} == {"lat", "lon"}:
                    found[path] = "geopoint"
                elif isinstance(f.dataType, T.StructType):
                    walk(f.dataType, f"{path}.")
                elif kind := _kind(f.dataType):
                    found[path] = kind

        walk(df.schema, "")
        return cls(found | known)

    def of(self, *kinds: str) -> list[str]:
        return [p for p, k in self.fields.items() if k in kinds]

    def strings(self) -> list[str]:
        return self.of("string", "string[]")

    def searchable(self) -> dict[str, str]:
        return dict(self.fields)

    def sortable(self) -> dict[str, str]:
        return {p: k for p, k in self.fields.items() if k in ("string", "number", "boolean")}

    def invalid(self, df: DataFrame) -> str | None:
        """The first path whose column cannot hold its kind."""
        for path, kind in self.fields.items():
            try:
                have = df.select(F.col(path)).schema[0].dataType
            except Exception:
                continue  # missing properties are legal
            if not _holds(have, kind):
                return path
        return None


def _kind(t: T.DataType) -> str | None:
    if isinstance(t, T.ArrayType):
        inner = _kind(t.elementType)
        return f"{inner}[]" if inner in ("string", "number", "boolean") else None
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "number" if isinstance(t, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)) else None


def _holds(t: T.DataType, kind: str) -> bool:
    if kind == "geopoint":
        return isinstance(t, T.StructType) and {x.name for x in t.fields} == {"lat", "lon"}
    if vector_size(kind):
        return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType)
    if kind == "enum":
        return _kind(t) in ("string", "number")
    if kind == "enum[]":
        return _kind(t) in ("string[]", "number[]")
    return _kind(t) == kind
