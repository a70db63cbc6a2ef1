"""Text expressions. Everything stays on the JVM side, NFKC included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteloom.vocab import NUMBER_PATTERN


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nfkc(c: Column | str) -> Column:
    """Compatibility composition by the ICU library that ships with Spark; ASCII text skips the call."""
    c = as_col(c)
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(F.octet_length(c) != F.char_length(c), composed).otherwise(c)


def norm(c: Column | str) -> Column:
    """Comparable form of a text: compatibility form, plain quotes and dashes, joined line breaks, one space, lower."""
    t = F.translate(nfkc(c), "’‘“”–—", "''\"\"--")
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.lower(F.trim(t))


def unescape(c: Column | str) -> Column:
    """Drops the Markdown escapes of ``*``, ``_`` and ``#``."""
    return F.regexp_replace(as_col(c), r"\\([*_#])", "$1")


def join_lines(c: Column | str) -> Column:
    """Joins words cut at a line end and turns line breaks into spaces."""
    t = F.replace(F.replace(as_col(c), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def numbers_in(c: Column | str) -> Column:
    """Absolute values of the numbers written in a text, decimal comma or point."""
    found = F.regexp_extract_all(F.coalesce(as_col(c), F.lit("")), F.lit(NUMBER_PATTERN), F.lit(0))
    parsed = F.transform(found, lambda x: F.abs(F.replace(x, F.lit(","), F.lit(".")).try_cast("double")))
    return F.filter(parsed, lambda x: x.isNotNull())


def words_of(c: Column | str) -> Column:
    return F.split(as_col(c), " ")


def word_count(c: Column | str) -> Column:
    """Words as split on any white space; an empty text has none."""
    t = F.trim(F.regexp_replace(as_col(c), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def blank(c: Column | str) -> Column:
    """True for null or white space only."""
    return F.coalesce(as_col(c), F.lit("")).rlike(r"(?U)^[\s\x1c-\x1f]*$")


def number_text(c: Column | str) -> Column:
    """Shortest text of a double: plain decimals from 1e-4 up to 1e16, outside of that a mantissa and an exponent of two digits."""
    c = as_col(c)
    raw = c.cast("string")
    plain = F.regexp_replace(F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1)
    digits = F.regexp_replace(power, "^-", "")
    exponent = F.concat(F.when(F.startswith(power, F.lit("-")), "-").otherwise("+"), F.when(F.char_length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    size = F.abs(c)
    return F.when(~F.contains(raw, F.lit("E")), raw).when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.concat(mantissa, F.lit("e"), exponent))


def json_value_text(kind: Column | str, num: Column | str, txt: Column | str) -> Column:
    """JSON text of a typed cell value; 1 and 1.0 stay different."""
    kind, num, txt = as_col(kind), as_col(num), as_col(txt)
    quoted = F.to_json(F.array(txt))
    return (
        F.when(kind == "int", F.coalesce(txt, num.cast("bigint").cast("string")))
        .when(kind == "float", number_text(num))
        .when(kind == "bool", txt)
        .when(kind == "str", F.substr(quoted, F.lit(2), F.char_length(quoted) - 2))
        .when(kind == "other", txt)
        .otherwise("null")
    )


def readable(c: Column | str) -> Column:
    """Technical references of the codebook in the wording of the sheet notes."""
    c = as_col(c)
    # names of trace fields lose their underscores, one reference at a time
    names = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)trazabilidad\.(\w+)"), F.lit(1)))
    longest_first = F.array_sort(names, lambda a, b: F.char_length(b) - F.char_length(a))
    t = F.aggregate(
        longest_first,
        c,
        lambda acc, n: F.replace(
            acc,
            F.concat(F.lit("trazabilidad."), n),
            F.concat(F.lit("el registro de trazabilidad ("), F.replace(n, F.lit("_"), F.lit(" ")), F.lit(")")),
        ),
    )
    t = F.replace(t, F.lit("(V14)"), F.lit("(regla V14 del libro)"))
    t = F.regexp_replace(t, r"(?U)\bes null\b", "está vacía")
    t = F.regexp_replace(t, r"(?U)\bnull\b", "celda vacía")
    t = F.replace(t, F.lit(" a el registro"), F.lit(" al registro"))
    return F.replace(t, F.lit(" de el registro"), F.lit(" del registro"))


def natural_key(c: Column | str) -> Column:
    """Sort key in which digit runs compare as numbers and letters without case."""
    runs = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"\d+|\D+"), F.lit(0))
    # a run's length goes before it, so runs of any length compare as numbers
    sized = lambda r: F.concat(F.lpad(F.char_length(r).cast("string"), 10, "0"), r)
    stripped = F.transform(
        runs,
        lambda r: F.when(r.rlike(r"^\d+$"), sized(F.regexp_replace(r, r"^0+(?=\d)", ""))).otherwise(r),
    )
    return F.array_join(stripped, "")
