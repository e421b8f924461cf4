"""Entity ids as column expressions: pure functions of names, so that every task makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(name: Column) -> Column:
    """A name without white space and quotes around it, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), "^`+|`+$", ""), '^"+|"+$', ""))


def segment(name: Column) -> Column:
    """A name as part of an id: plain names as they are, others by a hash of the name as given."""
    plain = F.regexp_replace(normal(name), "[. ]", "_")
    return F.when(plain.rlike("^[a-z0-9_:-]+$"), plain).otherwise(F.concat(F.lit("h_"), F.substring(F.sha1(name.cast("binary")), 1, 10)))


def table_path(catalog: Column, schema: Column, table: Column) -> Column:
    return F.concat(F.when(catalog != "default", F.concat(segment(catalog), F.lit("."))).otherwise(F.lit("")), segment(schema), F.lit("."), segment(table))


def table_id(catalog: Column, schema: Column, table: Column) -> Column:
    return F.concat(F.lit("table:"), table_path(catalog, schema, table))


def column_id(catalog: Column, schema: Column, table: Column, column: Column) -> Column:
    return F.concat(F.lit("column:"), table_path(catalog, schema, table), F.lit("."), segment(column))


def relation_id(alias: Column, scope: str = "root") -> Column:
    return F.concat(F.lit(f"scope_relation:{scope}:"), segment(alias))


def output_id(ordinal: Column, name: Column) -> Column:
    return F.concat(F.lit("output_column:scope:root:"), ordinal.cast("string"), F.lit(":"), segment(name))


def literal_id(ordinal: Column) -> Column:
    return F.concat(F.lit("literal:scope:root:"), ordinal.cast("string"))


def unknown_id(ordinal: Column, name: Column) -> Column:
    return F.concat(F.lit("unknown:scope:root:"), ordinal.cast("string"), F.lit(":"), segment(name))


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("edge:"), kind, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", kind, source, target).cast("binary")), 1, 12))


def location_id(entity: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("loc:"), F.substring(F.sha1(F.concat_ws(":", entity, start.cast("string"), end.cast("string")).cast("binary")), 1, 12))


def sql_id(sql: Column) -> Column:
    return F.concat(F.lit("sql:"), F.substring(F.sha2(sql.cast("binary"), 256), 1, 16))


def utf16_length(text: Column) -> Column:
    """Code units of the UTF-16 form."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a UTF-16 offset; CRLF ends one line."""
    before = before_offset(text, offset)
    return (F.char_length(before) - F.char_length(F.translate(before, "\n", "")) + 1).cast("int")


def column_of(text: Column, offset: Column) -> Column:
    """The column, from 1, in UTF-16 units, of a UTF-16 offset."""
    before = before_offset(text, offset)
    return (utf16_length(F.substring_index(before, "\n", -1)) + 1).cast("int")


def before_offset(text: Column, offset: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-16LE"), F.lit(1), offset.cast("int") * 2), "UTF-16LE")
