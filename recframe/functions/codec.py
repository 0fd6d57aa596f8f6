"""Between records and values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.errors import SpecError


def strip_separator(record: Column | str, separator: bytes) -> Column:
    """The record without its separator, if it ends with one."""
    record = F.col(record) if isinstance(record, str) else record
    if not separator:
        return record
    size = F.octet_length(record) - len(separator)
    return F.when((size >= 0) & (F.substring(record, size + 1, F.lit(len(separator))) == F.lit(separator)), F.substring(record, F.lit(1), size)).otherwise(record)


def terminate(record: Column | str, separator: bytes) -> Column:
    """The record with the separator after it, unless it ends so; nothing for an empty one."""
    record = (F.col(record) if isinstance(record, str) else record).cast("binary")
    size = F.octet_length(record) - len(separator)
    there = (size >= 0) & (F.substring(record, size + 1, F.lit(len(separator))) == F.lit(separator))
    return F.when((F.octet_length(record) == 0) | there, record).otherwise(F.concat(record, F.lit(separator)))


def text(record: Column | str) -> Column:
    """The record as a string, null where it isn't UTF-8; the bytes stay in the record column."""
    record = F.col(record) if isinstance(record, str) else record
    return F.try_validate_utf8(record.cast("string"))


def decode(df: DataFrame, format: str = "raw", separator: bytes = b"\n", schema: str | None = None, options: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """df with a value column read from its record column.

    raw: the text. json: a struct by `schema`, or a variant without one; a record that isn't JSON fails, or is null unless
    strict. csv and xml need a schema; logfmt gives a map of strings. The header of a CSV file is record 0: skip it before.
    """
    body = text(strip_separator("record", separator))
    options = options or {}
    if format == "raw":
        value = body
    elif format in ("json", "jsonl", "ndjson"):
        if schema is None:
            value = F.parse_json(body) if strict else F.try_parse_json(body)
        else:
            value = F.from_json(body, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"} | options)
    elif format == "csv":
        value = F.from_csv(body, _needed(schema, format), options)
    elif format == "xml":
        value = F.from_xml(body, _needed(schema, format), options)
    elif format == "logfmt":
        value = F.str_to_map(body, F.lit(" "), F.lit("="))
    else:
        raise SpecError(f"no reader for the format {format!r}: one of raw, json, csv, xml, logfmt")
    return df.withColumn("value", value)


def _needed(schema: str | None, format: str) -> str:
    if schema is None:
        raise SpecError(f"{format} needs a schema")
    return schema


def encode(df: DataFrame, format: str = "raw", separator: bytes = b"\n", column: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and a record column: raw takes one string or binary column, json and csv all columns but those kept."""
    columns = [c for c in df.columns if c not in keep]
    if format == "raw":
        column = column or (columns[0] if len(columns) == 1 else None)
        if column is None or dict(df.dtypes)[column] not in ("string", "binary"):
            raise SpecError("raw records come from one string or binary column: name it, or give a format")
        body = F.col(column)
    elif format in ("json", "jsonl", "ndjson"):
        body = F.to_json(F.struct(*columns))
    elif format == "csv":
        body = F.to_csv(F.struct(*columns))
    else:
        raise SpecError(f"no writer for the format {format!r}: one of raw, json, csv")
    return df.select(*keep, terminate(body, separator).alias("record"))


def count_separators(data: Column | str, separator: bytes) -> Column:
    """Whole records in a string column, without reading them one by one: occurrences of the separator, left to right."""
    data = F.col(data) if isinstance(data, str) else data
    mark = F.lit(separator.decode())
    return ((F.octet_length(data) - F.octet_length(F.replace(data, mark, F.lit("")))) / len(separator)).cast("long")
