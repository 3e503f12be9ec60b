"""Values inside JSON texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def replaced(text: str | None, path: tuple, value) -> str | None:
    """The JSON text with the value at a path of keys and places; a path that isn't there raises."""
    if text is None:
        return None
    out = json.loads(text)
    inner = out
    for step in path[:-1]:
        inner = inner[step]
    if path[-1] not in inner and isinstance(inner, dict) or isinstance(inner, list) and not -len(inner) <= path[-1] < len(inner):
        raise KeyError(path)
    inner[path[-1]] = value
    return json.dumps(out)


def set_path(text: Column, path: tuple, value: Column) -> Column:
    """The same for a column, in batches."""

    @F.pandas_udf("string")
    def each(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, path, v.item() if hasattr(v, "item") else v) for t, v in zip(texts, values, strict=True)], dtype=object)

    return each(text, value)
