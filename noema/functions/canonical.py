"""JSON of one form for one value: keys in order at every depth, no spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How JSON writes what can't stand in a string.
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(text: Column) -> Column:
    escaped = text
    for sign in [*_SHORT, *(chr(i) for i in range(32) if chr(i) not in _SHORT)]:
        escaped = F.replace(escaped, F.lit(sign), F.lit(_SHORT.get(sign, f"\\u{ord(sign):04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike('[\\x00-\\x1f"\\\\]'), escaped).otherwise(text), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """value as JSON. Keys of structs and of maps with text keys are sorted by code point at every depth, so neither the
    order of fields nor that of entries tells; nulls are null, dates and times text. Floating-point numbers stand as Spark
    writes them. A map's keys may be null nowhere, as in Spark."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: [ord(c) for c in f.name])
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of JSON are text")
        entries = F.array_sort(F.map_entries(F.transform_values(value, lambda k, v: canonical_json(v, kind.valueType))))
        made = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        made = value.cast("string")
    else:
        made = json_string(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(made)


def canonical_row(rows: DataFrame, *columns: str) -> Column:
    """The named columns of each row as one JSON object."""
    kind = T.StructType([rows.schema[c] for c in columns])
    return canonical_json(F.struct(*columns), kind)
