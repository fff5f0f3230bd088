"""Calls of outside functions on batches, and the batches that they are given."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Fatal(Exception):
    """What ends a run: no item of it can succeed."""


def called(rows: DataFrame, column: str, f: Callable[[list], list], kind: str, name: str) -> DataFrame:
    """``rows`` with (value, error) of an outside function: a batch is asked at once, and item by item where it fails;
    a Fatal error ends the run."""

    @F.pandas_udf(f"value {kind}, error string")
    def ask(items: pd.Series) -> pd.DataFrame:
        given = items.tolist()
        try:
            return pd.DataFrame({"value": f(given), "error": None})
        except Fatal:
            raise
        except Exception:
            out = []
            for x in given:
                try:
                    out.append((f([x])[0], None))
                except Fatal:
                    raise
                except Exception as e:
                    out.append((None, str(e)))
            return pd.DataFrame(out, columns=["value", "error"]).astype({"error": object})

    return rows.withColumn(name, ask(column))


def without_empties(value):
    """A JSON value without empty texts, lists and objects, blank keys and numbers that are not finite; None if nothing is left."""
    if isinstance(value, dict):
        kept = {k.strip(): x for k, v in value.items() if k.strip() and (x := without_empties(v)) is not None}
        return kept or None
    if isinstance(value, list):
        return [x for v in value if (x := without_empties(v)) is not None] or None
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def clean_json(c: Column) -> Column:
    """JSON text of any depth cleaned; null where it cannot be read or nothing is left."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                x = without_empties(json.loads(t)) if t else None
            except ValueError:
                return None
            return None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True)

        return texts.map(one)

    return clean(c)
