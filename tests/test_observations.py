"""Observation load / upsert / delete / list."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import observations as O


def _raw(spark, rows):
    """rows: list of dicts of some fields; others blank; row_idx = position."""
    data = []
    for i, r in enumerate(rows):
        data.append(tuple(r.get(f, "") for f in O.ALL_FIELDS) + (i,))
    schema = ", ".join(f"`{f}` string" for f in O.ALL_FIELDS) + ", row_idx long"
    return spark.createDataFrame(data, schema)


ROWS = [
    {"category": "dup_cust", "ObservationTitle": "Dup Cust!", "RiskType": "High"},
    {"category": "bogus", "ObservationTitle": "x"},
    {},
    {"category": " prod_gst ", "entity_key": "EK1", "table_name": "T"},
    {"category": "hr_same_pan", "table_name": "Same PAN"},
    {"category": "itc_pwd_stale"},
]


def test_classify_and_accounting(spark):
    acct = O.upload_accounting(_raw(spark, ROWS)).first()
    assert (acct["inserted"], acct["skipped"], acct["ignored_blank"], acct["total"]) == (4, 1, 1, 6)
    loaded = {r["category"]: r["entity_key"] for r in O.observations_load(_raw(spark, ROWS)).collect()}
    assert loaded == {"dup_cust": "dup_cust", "prod_gst": "EK1", "hr_same_pan": "same_pan",
                      "itc_pwd_stale": "row_7"}


def test_seed_categories_only(spark):
    loaded = O.observations_load(_raw(spark, ROWS), O.SEED_CATEGORIES)
    assert sorted(r["category"] for r in loaded.collect()) == ["dup_cust", "prod_gst"]


def test_required_columns(spark):
    df = spark.createDataFrame([("a",)], "category string")
    with pytest.raises(ValueError, match="Missing required columns"):
        O.required_columns(df)


def test_header_canonicalisation(spark):
    df = spark.createDataFrame([("x", "y")], "`Observation Title` string, `risk_type` string")
    assert O.canon_headers(df).columns == ["ObservationTitle", "RiskType"]


def test_upsert_and_delete(spark):
    from ledgerlens.sinks.tables import materialize

    stored = materialize(O.observations_load(_raw(spark, ROWS)), "test-obs")  # the stored upload
    snap = materialize(O.dense_ids(stored, 0, "row_idx").drop("row_idx"), "test-snap")
    ids = {r["category"]: r["id"] for r in snap.collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4]
    changes = spark.createDataFrame(
        [(ids["dup_cust"], 1, "dup_cust", "Edited"), (999, 2, "multi_tax", "Ghost"), (None, 3, "prod_code", "New A"),
         (None, 4, "prod_name", "New B")],
        "id long, seq long, category string, ObservationTitle string")
    out = {r["id"]: r for r in O.observations_upsert(snap, changes).collect()}
    assert out[ids["dup_cust"]]["ObservationTitle"] == "Edited"
    assert out[ids["dup_cust"]]["RiskType"] == ""  # every field replaced
    assert 999 not in out  # update of a missing id is a no-op
    assert out[5]["ObservationTitle"] == "New A" and out[6]["ObservationTitle"] == "New B"
    left = O.observations_delete(snap, spark.createDataFrame([(ids["prod_gst"],)], "id long"))
    assert sorted(r["id"] for r in left.collect()) == sorted(set(ids.values()) - {ids["prod_gst"]})
    listed = O.observations_list(snap, "dup_cust").collect()
    assert [r["category"] for r in listed] == ["dup_cust"]


def test_dense_ids_many_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7 + 3).alias("k"))
    got = O.dense_ids(df, 100, "k").agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(got) == (101, 5100, 5000)
    first = O.dense_ids(df, 0, "k").filter("k = 3").first()["id"]
    assert first == 1


def test_values_cleaned_together_as_one_by_one(spark):
    from ledgerlens.functions import safe_value, safe_values

    texts = [None, "", " ", "nan", "NaN", " nan\u00a0", "nan.", "\u3000x y\t", "plain", "\u00e9 ", "n\u00e4n", "-", "a", " a"]
    df = spark.createDataFrame([(t, t[::-1] if t else t, len(t) if t else None) for t in texts], "a string, b string, c int")
    got = df.select(safe_values(["a", "b", F.col("c")]).alias("v"), *[safe_value(c).alias(c) for c in "abc"]).collect()
    assert [tuple(r.v) for r in got] == [(r.a, r.b, r.c) for r in got]


def test_load_cleans_once_and_ids_take_one_shuffle(spark):
    raw = _raw(spark, ROWS)
    plan = O.observations_load(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") <= 2  # not again in a filter
    ids = O.dense_ids(spark.range(100).select((F.col("id") % 50).alias("k")), 0, "k")
    got = [(r.id, r.k) for r in ids.orderBy("id").collect()]
    assert got == [(i + 1, i // 2) for i in range(100)]
    assert "row_number" not in ids._jdf.queryExecution().optimizedPlan().toString()


def test_store_reads_a_load_once(spark, monkeypatch):
    stored, write = [], O.materialize
    monkeypatch.setattr(O, "materialize", lambda df, name: stored.append(df) or write(df, name))
    loaded = O.observations_load(_raw(spark, ROWS))
    table = O.dense_ids(loaded, 0, "row_idx").withColumn("updated_at", F.lit("old"))
    stored.clear()
    got = O.observations_store(table, loaded, F.lit("new"))
    assert got.filter("updated_at = 'new'").count() == got.count() == loaded.count()
    assert stored[0] is loaded  # written before its order, rows and categories are read


def test_blank_rows_of_a_blank_category_stay_out(spark):
    raw = spark.createDataFrame([(0, " ", None), (1, "nan", "T"), (2, "dup_cust", "")], "row_idx long, category string, ObservationTitle string")
    raw = raw.withColumns({f: F.lit("") for f in O.ALL_FIELDS if f not in ("category", "ObservationTitle")})
    got = O.observations_load(raw, ["", "dup_cust"]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.category, r.entity_key) for r in got] == [(1, "", "t"), (2, "dup_cust", "row_4")]
