from datetime import datetime

from driftwood.operators.parse import parse

REFERENCE = datetime(2026, 8, 20)


def lines_of(spark, texts, source="s"):
    rows = [(source, i, t, False) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "source string, ordinal bigint, text string, used_fallback boolean")


def parsed(spark, texts, format="plain", **more):
    more.setdefault("reference", REFERENCE)
    return parse(lines_of(spark, texts), format, **more)


def rows_of(spark, texts, format="plain", **more):
    found = parsed(spark, texts, format, **more).entries.orderBy("ordinal").collect()
    return [r.asDict(recursive=True) for r in found]
