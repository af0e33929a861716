"""Errors carry the code by which callers tell them apart."""

from __future__ import annotations

PLAN_CODES = frozenset(
    """UNKNOWN_INDEX INVALID_BOOST_VALUE UNKNOWN_FILTER_PROPERTY INVALID_FILTER_OPERATION FACET_NOT_SUPPORTED
    UNKNOWN_GROUP_BY_PROPERTY INVALID_GROUP_BY_PROPERTY UNABLE_TO_SORT_ON_UNKNOWN_FIELD SORT_DISABLED
    UNKNOWN_VECTOR_PROPERTY INVALID_INPUT_VECTOR INVALID_VECTOR_INPUT INVALID_VECTOR_SIZE INVALID_SEARCH_MODE
    LANGUAGE_NOT_SUPPORTED PROPERTY_NOT_STORED INVALID_DISTANCE_SUFFIX RESERVED_SCHEMA_PROPERTY SUGGEST_NOT_SUPPORTED
    MISSING_STEMMER PLUGIN_COMPONENT_CONFLICT WRONG_SEARCH_PROPERTY_TYPE UNSUPPORTED_COMPONENT MISSING_TERM
    INVALID_STORE_CONFIG FREEZE_NOT_SUPPORTED VECTOR_NOT_STORED INVALID_STEMMER_FUNCTION_TYPE""".split()
)
INGEST_CODES = frozenset(
    """SCHEMA_VALIDATION_FAILURE DOCUMENT_ALREADY_EXISTS DOCUMENT_ID_MUST_BE_STRING INVALID_DOCUMENT_PROPERTY
    INVALID_SCHEMA_TYPE INVALID_BATCH_SIZE DOCUMENT_DOES_NOT_EXIST""".split()
)


class SeekError(Exception):
    def __init__(self, code: str, detail: object = ""):
        if code not in PLAN_CODES | INGEST_CODES:
            raise ValueError(f"no such code: {code}")
        super().__init__(f"{code}: {detail}" if detail != "" else code)
        self.code = code
