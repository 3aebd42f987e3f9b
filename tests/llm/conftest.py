import pytest


@pytest.fixture
def docs(spark):
    """Awkward documents: null and empty texts, ties, repeated rows, null columns, a clashing extra column."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("text", "lang", "source", "size", "ids")])
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    rows = [
        (1, base, "en", "a", "x", "y"), (1, base, "en", "a", "x", "y"), (2, base.upper(), "en", None, None, None), (3, None, None, "b", "x", "y"), (4, "", "en", "b", None, None),
        (5, " \t\n ", "de", "c", None, None), (6, "two words", "de", "c", None, None), (None, "no id here at all", "fr", "a", None, None),
        (7, (base + " é漢😀 ▁ <0x41> ") * 300, "en", "c", None, None), (8, "nospace" * 3000, "en", "a", None, None), (9, "a\x0bb\x0cc\xa0d e\x1cf", "en", "d", None, None),
    ]
    return spark.createDataFrame(rows, schema)
