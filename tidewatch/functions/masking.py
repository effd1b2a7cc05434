"""Masking of sensitive values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# A key containing one of these is masked with this text.
SENSITIVE = ("password", "token", "api_key", "secret", "auth", "credential")
MASK = "***MASKED***"
_PATTERN = "(?i)" + "|".join(SENSITIVE)


def mask_map(labels: Column) -> Column:
    """Mask the values of sensitive keys of a flat map."""
    return F.transform_values(labels, lambda k, v: F.when(k.rlike(_PATTERN), MASK).otherwise(v))


def mask_struct(column: Column, dtype: T.DataType, name: str = "") -> Column:
    """Mask a nested column of known type; runs inside the JVM.

    A sensitive field becomes text whatever its type was; in a map of other values than text the
    value of a sensitive key becomes null.
    """
    if any(word in name.lower() for word in SENSITIVE):
        return F.lit(MASK)
    if isinstance(dtype, T.StructType):
        fields = [mask_struct(column[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: mask_struct(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        if isinstance(dtype.valueType, T.StringType):
            return mask_map(column)
        # values of sensitive keys cannot turn into text here, so they become null
        return F.transform_values(
            column, lambda k, v: F.when(~k.cast("string").rlike(_PATTERN), mask_struct(v, dtype.valueType))
        )
    return column


def _mask_value(value):
    if isinstance(value, dict):
        return {
            k: MASK if any(w in k.lower() for w in SENSITIVE) else _mask_value(v)
            for k, v in value.items()
        }
    if isinstance(value, list):
        return [_mask_value(v) for v in value]
    return value


def _mask_text(text):
    if text is None:
        return None
    try:
        parsed = json.loads(text)
        if not isinstance(parsed, (dict, list)):
            return text
        return json.dumps(_mask_value(parsed), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return text
    except RecursionError:
        return MASK


@F.pandas_udf(T.StringType())
def mask_json(texts: pd.Series) -> pd.Series:
    """Mask JSON text of unknown shape.

    Text that is not JSON is left alone; text nested too deeply to be looked through is masked as a whole.
    """
    return texts.map(_mask_text)
