"""Typed cell values: struct of kind, number and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteloom.functions.text import json_value_text, number_text
from quoteloom.vocab import VALUE_TOLERANCE

#: Whole numbers from here on may have no double of their own.
EXACT = float(1 << 53)
CELL_TYPE = "struct<kind:string,num:double,str:string>"


def cell(kind: Column, num: Column, txt: Column) -> Column:
    return F.struct(kind.alias("kind"), num.cast("double").alias("num"), txt.cast("string").alias("str"))


def null_cell() -> Column:
    return cell(F.lit("null"), F.lit(None), F.lit(None))


def _of(c: Column, kind: str, num: Column, txt: Column) -> Column:
    """A cell whose parts are null where ``c`` is: one plain record, so that Spark takes a part without building it."""
    return cell(F.when(c.isNull(), "null").otherwise(kind), num, txt)


def text_cell(c: Column) -> Column:
    return _of(c, "str", F.lit(None), c)


def float_cell(c: Column) -> Column:
    return _of(c, "float", c, F.lit(None))


def int_cell(c: Column) -> Column:
    """Whole number; ``str`` keeps its digits where a double does not hold them exactly."""
    digits = c.cast("string")
    exact = F.when(F.abs(c.try_cast("double")) >= EXACT, F.when(digits.rlike(r"^-?\d+$"), F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1")))
    return _of(c, "int", c.try_cast("double"), exact)


def bool_cell(c: Column) -> Column:
    return F.when(c.isNull(), null_cell()).otherwise(cell(F.lit("bool"), F.lit(None), c.cast("string")))


def variant_cell(v: Column) -> Column:
    """Cell of a VARIANT value; objects and arrays keep their JSON text."""
    kind = F.schema_of_variant(v)
    number = v.try_cast("double")
    return (
        F.when(v.isNull() | (kind == "VOID"), null_cell())
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), cell(F.lit("int"), number, F.when(F.abs(number) >= EXACT, v.try_cast("string"))))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), cell(F.lit("float"), number, F.lit(None)))
        .when(kind == "BOOLEAN", cell(F.lit("bool"), F.lit(None), F.to_json(v)))
        .when(kind == "STRING", cell(F.lit("str"), F.lit(None), v.try_cast("string")))
        .otherwise(cell(F.lit("other"), F.lit(None), F.to_json(v)))
    )


def is_null(c: Column) -> Column:
    return c.isNull() | (c["kind"] == "null")


def is_number(c: Column) -> Column:
    return F.coalesce(c["kind"].isin("int", "float"), F.lit(False))


def cell_json(c: Column) -> Column:
    return F.when(c.isNull(), "null").otherwise(json_value_text(c["kind"], c["num"], c["str"]))


def cell_text(c: Column) -> Column:
    """Plain text of a value, null for a missing one."""
    return (
        F.when(c["kind"] == "int", F.coalesce(c["str"], c["num"].cast("bigint").cast("string")))
        .when(c["kind"] == "float", number_text(c["num"]))
        .otherwise(c["str"])
    )


def value_key(c: Column) -> Column:
    """Key under which equal values meet: 1 and 1.0 are one number, and a text is no number."""
    whole = is_number(c) & (F.abs(c["num"]) < EXACT) & (c["num"] == F.floor(c["num"]))
    return F.when(whole, c["num"].cast("bigint").cast("string")).otherwise(cell_json(c))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def cells_equal(a: Column, b: Column) -> Column:
    """Booleans equal only booleans, numbers within the tolerance, texts without outer space, else the same JSON."""
    ka = F.coalesce(a["kind"], F.lit("null"))
    kb = F.coalesce(b["kind"], F.lit("null"))
    return (
        F.when((ka == "bool") | (kb == "bool"), (ka == kb) & a["str"].eqNullSafe(b["str"]))
        .when((ka == "int") & (kb == "int") & a["str"].isNotNull() & b["str"].isNotNull(), a["str"] == b["str"])
        .when(is_number(a) & is_number(b), F.abs(a["num"] - b["num"]) <= VALUE_TOLERANCE)
        .when((ka == "str") & (kb == "str"), (a["str"] == b["str"]) | (_strip(a["str"]) == _strip(b["str"])))
        .otherwise((ka == kb) & a["str"].eqNullSafe(b["str"]))
    )
