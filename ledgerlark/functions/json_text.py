"""Pruning JSON texts of unknown depth: the one place where built-in functions cannot follow the structure."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NOTHING = ...  # a singleton in every process


def _kept(value: Any, needle: str) -> Any:
    if isinstance(value, dict):
        out = {k: v if needle in k.lower() else _kept(v, needle) for k, v in value.items()}
        out = {k: v for k, v in out.items() if v is not _NOTHING}
        return out or _NOTHING
    if isinstance(value, list):
        out = [v for v in (_kept(v, needle) for v in value) if v is not _NOTHING]
        return out or _NOTHING
    shown = "null" if value is None else str(value).lower()
    return value if needle in shown else _NOTHING


def prune(column: Column, query: str) -> Column:
    """The branches of a JSON text whose key or value contains ``query``, in any case; null where none does or it isn't JSON."""
    needle = query.lower()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                out = _kept(json.loads(text), needle)
            except (TypeError, ValueError):
                return None
            return None if out is _NOTHING else json.dumps(out, ensure_ascii=False)

        return texts.map(one)

    return run(column)
