"""Queries and SQL of this folder's operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "html_text", "minhash", "token_counts", "packing", "quality", "fingerprint", "placement", "warc", "line_dedup")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
