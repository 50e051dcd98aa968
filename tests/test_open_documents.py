"""Documents with keys that no schema declares."""

import pytest
from pyspark.sql import types as T

from furlong.sources import documents as D

SCHEMA = T.StructType([T.StructField("id", T.LongType())])


def test_keys_outside_the_schema_are_found_and_read(spark):
    texts = ['{"id": 1, "a": 2, "b": "x", "it\'s": true}', '{"id": 2, "a": 2.5, "b": 7, "c": null}', '{"id": 3, "d": {"e": [1]}}', "broken {", None, "[1, 2]", "5"]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "data string, n int")
    got = {(r.key, r.kind): r.documents for r in D.key_profile(df, declared=SCHEMA).collect()}
    assert got == {("a", "number"): 2, ("b", "text"): 1, ("b", "number"): 1, ("c", "null"): 1, ("d", "object"): 1, ("it's", "boolean"): 1}
    assert ("id", "number") in {(r.key, r.kind) for r in D.key_profile(df).collect()}
    out = D.parse_open(df, SCHEMA)
    assert [f.dataType.simpleString() for f in out.schema.fields if f.name in ("a", "b", "d", "it's")] == ["double", "variant", "variant", "boolean"]
    rows = {r.n: r for r in out.collect()}
    assert (rows[0].a, rows[1].a, rows[0]["it's"], rows[2].id) == (2.0, 2.5, True, 3)
    assert rows[3][D.CORRUPT] == "broken {" and rows[3].a is None and len(rows) == len(texts)
    with pytest.raises(ValueError, match="undeclared"):
        D.parse_open(df, SCHEMA, most=2)
