"""Case folding as a column, against the language's own on every code point."""

from pyspark.sql import functions as F

from tessergraph.functions import text


def test_every_code_point(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    held = ["".join(map(chr, points[i : i + 61])) for i in range(0, len(points), 61)] + [chr(c) for c in range(1, 0x600)]
    held += ["", "plain ASCII Text", "Straße ǅ İI ﬃ ΆΣς ᾳ", "ŉ" * 5, "𐐀𐐨", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "i int, t string").select("i", text.casefold("t").alias("f")).collect()
    wrong = [(held[r.i], r.f) for r in rows if r.f != (None if held[r.i] is None else held[r.i].casefold())]
    assert not wrong, wrong[:3]


def test_no_python(spark):
    plan = spark.range(1).select(text.casefold(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
