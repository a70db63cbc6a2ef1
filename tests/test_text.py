import re
import unicodedata

from pyspark.sql import functions as F

from quoteloom.functions.canonical import canonical_json_udf, response_json, response_objects
from quoteloom.functions.text import join_lines, natural_key, norm, number_text, numbers_in, readable, unescape, word_count

# one text per sample of each general category that the compatibility form or the space rule may touch, plus the marks norm() maps
SAMPLES = {
    "compatibility forms": [chr(c) for c in range(0x80, 0x3400) if unicodedata.decomposition(chr(c)).startswith("<")][::37],
    "composed letters": [chr(c) for c in range(0xC0, 0x2000) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")][::61],
    "spaces and separators": [chr(c) for c in range(0x3100) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp") or chr(c).isspace()],
    "dashes and quotes": [chr(c) for c in range(0x2010, 0x2020)] + ["'", '"', "-\n"],
    "scripts": [unicodedata.lookup(n) for n in ("HEBREW LETTER SHIN", "DEVANAGARI LETTER KA", "HANGUL SYLLABLE GAG", "CYRILLIC CAPITAL LETTER YA", "GREEK CAPITAL LETTER SIGMA")],
}
TEXTS = ["", "Plain Words stay"] + [f"Qa{x}B {x}{x} z" for group in SAMPLES.values() for x in group]


def python_norm(t):
    t = unicodedata.normalize("NFKC", t)
    for a, b in (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("-\n", "")):
        t = t.replace(a, b)
    return re.sub(r"\s+", " ", t).strip().lower()


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_norm_equals_the_plain_definition(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", norm("t").alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: python_norm(t) for t in TEXTS}


def test_norm_of_null(spark):
    assert one(spark, norm("x"), None) is None


def test_small_helpers(spark):
    assert one(spark, unescape("x"), r"\*\* p<.001 cr\_fdh") == "** p<.001 cr_fdh"
    assert one(spark, join_lines("x"), " facto-\nrial\nuno ") == "factorial uno"
    assert one(spark, numbers_in("x"), "r = -0,35 y .73** en 2, 1.2.3") == [0.35, 0.73, 2.0, 1.2, 0.3]
    assert one(spark, word_count("x"), "  uno dos\ntres ") == 3 and one(spark, word_count("x"), " ") == 0
    assert one(spark, readable("x"), "según trazabilidad.id_muestra es null y null (V14)") == (
        "según el registro de trazabilidad (id muestra) está vacía y celda vacía (regla V14 del libro)")
    assert one(spark, natural_key("x"), "Doc 10") > one(spark, natural_key("x"), "doc 9")
    long = "7" * 24
    assert one(spark, natural_key("x"), f"d{long}18") > one(spark, natural_key("x"), f"d{long}17") > one(spark, natural_key("x"), f"d{long}")


def test_number_text(spark):
    values = [0.0005, 1e-4, 9.99e-5, 1e8, 12345678.5, 1e15, 1e16, 1.5e20, -2.5e-7, 0.1, 3.0, -0.0, 1.25e-300]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", number_text("x").alias("y")).collect()
    assert [r.y for r in got] == [repr(r.x) for r in got]


def test_canonical_json_keeps_numbers(spark):
    assert one(spark, canonical_json_udf("x"), '{"b": 1.0, "a": [1, "ñ"]}') == '{"a":[1,"ñ"],"b":1.0}'


def test_response_json(spark):
    assert one(spark, response_json("x"), 'ok ```json\n[{"a": 1}]\n``` fin') == '[{"a": 1}]'
    assert one(spark, response_json("x"), 'va [1, {"a": 2}] y más [') == '[1, {"a": 2}]'
    assert one(spark, response_json("x"), "sin nada") is None and one(spark, response_json("x"), "{cortado") is None
    assert one(spark, response_objects("x"), '{"a": 1}') == ['{"a": 1}'] and one(spark, response_objects("x"), "[1, 2]") is None
