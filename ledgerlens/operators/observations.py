"""Audit observations: load, upsert, delete, list.

The observation table is a set of rows keyed by ``id``; every mutation is
expressed as a DataFrame transformation producing the next snapshot
(written by ``ledgerlens.sinks``), so it runs on executors and a failed
task is simply recomputed.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import canonical_header_name, entity_key, safe_value, safe_values, strip
from ledgerlens.sinks.tables import materialize

# The 35 observation fields, in table order.
ALL_FIELDS = [
    "category", "table_name", "entity_key", "ObservationTitle",
    "ObservationSubProcess", "RepeatObservation", "ObservationType",
    "RiskType", "Department", "SBU", "FollowUpFrequency", "ShareWith",
    "ObservationDescription", "ShortObservation", "RootCause",
    "ImpactConcern", "FinancialImplication", "Auditee", "OtherAuditee",
    "Escalator1", "Escalator2", "Escalator3", "Recommendation",
    "CorrectiveActionPlan", "PreventiveActionPlan", "ShortActionPlan",
    "TargetDateNotApplicable", "TargetDate", "RevisedTargetDate",
    "PercentageCompletedAuditee", "PercentageCompletedAuditor",
    "ClosureDate", "ClosureReason", "FromDate", "ToDate",
]
# Observation categories accepted by an upload (16) and by seeding (5).
VALID_CATEGORIES = [
    "multi_tax", "prod_gst", "dup_cust", "prod_name", "prod_code",
    "itc_access_lwd", "itc_inactive_90", "itc_pwd_stale",
    "itc_after_hours", "itc_failed_login", "itc_above_limit",
    "hr_dup_bank", "hr_dup_pan_aadhaar", "hr_missing_ids",
    "hr_missing_master", "hr_same_pan",
]
SEED_CATEGORIES = ["multi_tax", "prod_gst", "dup_cust", "prod_name", "prod_code"]
# Category code -> display title (used as table_name on save).
CATEGORY_TITLES = {
    "multi_tax": "Multiple Tax Code",
    "prod_gst": "Same Product Multiple GST Rate",
    "dup_cust": "Duplicate Customer Name",
    "prod_name": "Product Name Check",
    "prod_code": "Product Code Check",
    "itc_access_lwd": "Access After Last Working Day",
    "itc_inactive_90": "Users Not Logged In for 90+ Days",
    "itc_pwd_stale": "Password Not Changed",
    "itc_after_hours": "Login Outside Business Hours",
    "itc_failed_login": "Multiple Failed Login Attempts",
    "itc_above_limit": "Approved Above Authorized Limit",
    "hr_dup_bank": "Multiple employees using same bank account",
    "hr_dup_pan_aadhaar": "Duplicate PAN/Aadhaar/Bank Account",
    "hr_missing_ids": "Missing PAN/Aadhaar/Bank Account",
    "hr_missing_master": "Missing Department/Location/Grade",
    "hr_same_pan": "Multiple employees with same PAN",
}
# Declared types of the stored observation columns (text unless listed).
TYPED_FIELDS = {
    "RepeatObservation": "boolean",
    "TargetDateNotApplicable": "boolean",
    "TargetDate": "date",
    "RevisedTargetDate": "date",
    "ClosureDate": "date",
    "FromDate": "date",
    "ToDate": "date",
    "PercentageCompletedAuditee": "decimal(5,2)",
    "PercentageCompletedAuditor": "decimal(5,2)",
}


def canon_headers(df: DataFrame, names: list[str] = ALL_FIELDS) -> DataFrame:
    """Rename columns whose alphanumeric lower-case form matches a field name."""
    canon = {canonical_header_name(n): n for n in names}
    mapping = {c: canon[canonical_header_name(c)] for c in df.columns if canonical_header_name(c) in canon}
    return df.withColumnsRenamed(mapping) if mapping else df


def required_columns(df: DataFrame, names: list[str] = ALL_FIELDS) -> None:
    """Reject an upload lacking any of the fields (schema check, driver side)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def fill_columns(df: DataFrame, names: list[str] = ALL_FIELDS) -> DataFrame:
    """Seeding: columns a workbook lacks are blank; a warning names them."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        warnings.warn(f"Missing columns are left blank: {', '.join(missing)}", stacklevel=2)
    return df.withColumns({n: F.lit("") for n in missing}) if missing else df


def classify_rows(raw: DataFrame, valid: list[str] = VALID_CATEGORIES, row_col: str = "row_idx",
                  fill_missing: bool = False) -> DataFrame:
    """W6 + W7 + P7: clean every field (F1), tag each row, fill the entity key.

    Adds ``_outcome`` in {'blank', 'skipped', 'inserted'}.  A row is blank
    when all 35 fields are blank (checked before the category).  The entity
    key fallback uses row number ``row_idx + 2`` (header row + 1-based).
    """
    df = canon_headers(raw)
    if fill_missing:
        df = fill_columns(df)
    required_columns(df)
    # Step 1: clean all fields once (one array in its own projection, so the
    # cleaned values are computed once and referenced by place afterwards).
    # The category has a column of its own: filters by it don't need the others.
    cleaned = df.select(safe_value("category").alias("category"), safe_values([F.col(f"`{f}`") for f in ALL_FIELDS]).alias("_values"), F.col(row_col))
    cleaned = cleaned.select(*[(F.col("category") if f == "category" else F.col("_values")[i]).alias(f) for i, f in enumerate(ALL_FIELDS)],
                             F.col(row_col), F.forall("_values", lambda value: value == "").alias("_blank"))
    blank = F.col("_blank")
    valid_cat = F.col("category").isin(valid)
    outcome = F.when(blank, F.lit("blank")).when(~valid_cat, F.lit("skipped")).otherwise(F.lit("inserted"))
    row_num = F.col(row_col) + 2
    key = F.when(F.col("entity_key") == "",
                 entity_key(F.col("ObservationTitle"), F.col("table_name"), row_num)).otherwise(F.col("entity_key"))
    cols = [key.alias(f) if f == "entity_key" else F.col(f) for f in ALL_FIELDS]
    return cleaned.select(*cols, F.col(row_col), outcome.alias("_outcome"))


def observations_load(raw: DataFrame, valid: list[str] = VALID_CATEGORIES, row_col: str = "row_idx",
                      fill_missing: bool = False) -> DataFrame:
    """K3 / K4 rows: the valid, non-blank rows of an upload, with entity keys.

    ``fill_missing`` (seeding): fields the upload lacks are blank, not an error.
    """
    raw = canon_headers(raw)
    if fill_missing:
        raw = fill_columns(raw)
    required_columns(raw)
    # Rows of other categories go before the rest is cleaned; a row of a category that is not blank is no blank row.
    rows = classify_rows(raw.filter(safe_value("category").isin(valid)), valid, row_col)
    return (rows.filter(F.col("_outcome") == "inserted") if "" in valid else rows).drop("_outcome")


def upload_accounting(raw: DataFrame, valid: list[str] = VALID_CATEGORIES, row_col: str = "row_idx") -> DataFrame:
    """Inserted / skipped / ignored-blank counts (and total) in one pass."""
    o = F.col("_outcome")
    return classify_rows(raw, valid, row_col).agg(
        F.count_if(o == "inserted").alias("inserted"),
        F.count_if(o == "skipped").alias("skipped"),
        F.count_if(o == "blank").alias("ignored_blank"),
        F.count(F.lit(1)).alias("total"),
    )


def typed_view(obs: DataFrame) -> DataFrame:
    """Observation rows with declared types: blank -> null, dates / decimals / booleans parsed."""
    cols = []
    for f in obs.columns:
        c = F.col(f"`{f}`")
        if f in TYPED_FIELDS:
            t = TYPED_FIELDS[f]
            s = F.nullif(F.trim(c.cast("string")), F.lit(""))
            if t == "boolean":
                low = F.lower(s)
                c = F.when(low.isin("true", "yes", "y", "1"), F.lit(True)).when(
                    low.isin("false", "no", "n", "0"), F.lit(False))
            else:
                c = s.try_cast(t)
        cols.append(c.alias(f))
    return obs.select(*cols)


def dense_ids(df: DataFrame, start: Column | int, order_col: str) -> DataFrame:
    """Assign ids ``start+1 .. start+n`` in ``order_col`` order (a unique key).

    Rows are range-partitioned by ``order_col``, whose bounds Spark samples, so
    partitions are even however the keys bunch; each is sorted and written
    with its number and every row's place in it (the low 33 bits of Spark's
    increasing id).  An id is the number of rows in earlier partitions, plus
    that place.  The counts per partition travel as one scalar, bounded by the
    number of partitions.  No single-task sort, and one shuffle.  Sampling
    computes the input once more, so an input that is dear is best a written table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, order_col).sortWithinPartitions(order_col).withColumns(
        {"_b": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = materialize(placed, "dense-ids")
    counts = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))
        .agg(F.map_from_entries(F.collect_list(F.struct("_b", "_off"))).alias("m"))
        .scalar()
    )
    start_col = start if isinstance(start, Column) else F.lit(start)
    ids = (start_col + F.element_at(offsets, F.col("_b")) + F.col("_place") + 1).cast("long")
    return ranged.withColumn("id", ids).drop("_b", "_place")


def observations_store(current: DataFrame, loaded: DataFrame, stamped: Column, replace: bool = True,
                       order_col: str = "row_idx") -> DataFrame:
    """K3 / K4 on stored rows: the table (fields, id, updated_at) after a load.

    With ``replace`` the categories that the load holds are replaced, others
    stay; without (seeding) its rows are added.  New rows get ids in upload
    order, after the highest that the table has had so far, and ``stamped``
    as ``updated_at``; rows that stay keep theirs.
    """
    highest = current.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    loaded = materialize(loaded, "observations-load")  # read for its order, its rows and its categories
    fresh = dense_ids(loaded, highest, order_col).withColumn("updated_at", stamped)
    if replace:
        # At most as many rows as there are valid categories.
        current = current.join(loaded.select("category").distinct(), "category", "left_anti")
    columns = [*ALL_FIELDS, "id", "updated_at"]
    return current.select(*columns).unionByName(fresh.select(*columns))


def observations_upsert(snapshot: DataFrame, changes: DataFrame, order_col: str = "seq",
                        stamped: Column | None = None, highest: int | None = None) -> DataFrame:
    """K5: apply saved forms to the observation snapshot.

    ``changes`` has an optional ``id`` and the 35 fields (missing -> '').
    With an id: every field of that row is replaced (no row is created when
    the id does not exist).  Without: a new row with the next free id.
    Several changes to one id: the last by ``order_col`` wins.  Rows that
    change or are new get ``stamped`` as ``updated_at`` where the table has it.
    New ids follow ``highest``, or else the snapshot's largest.
    """
    fields = {f: F.coalesce(strip(F.col(f"`{f}`").cast("string")), F.lit("")) if f in changes.columns else F.lit("")
              for f in ALL_FIELDS}
    ch = changes.select(F.col("id").cast("long").alias("id"), F.col(order_col).alias("_seq"),
                        *[v.alias(f) for f, v in fields.items()])
    updates = (
        ch.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct(F.col("_seq"), *[F.col(f) for f in ALL_FIELDS])).alias("u"))
        .select("id", *[F.col(f"u.{f}").alias(f) for f in ALL_FIELDS])
    )
    keep = [c for c in snapshot.columns if c not in ALL_FIELDS]
    dated = stamped is not None and "updated_at" in snapshot.columns
    kept = [F.when(F.col("_hit"), stamped).otherwise(F.col(c)).alias(c) if dated and c == "updated_at" else F.col(c) for c in keep]
    updates = updates.withColumnsRenamed({f: f"_new_{f}" for f in ALL_FIELDS}).withColumn("_hit", F.lit(True))
    updated = (
        snapshot.join(updates, "id", "left")
        .select(*kept, *[F.coalesce(F.col(f"_new_{f}"), F.col(f)).alias(f) for f in ALL_FIELDS])
        .select(*snapshot.columns)
    )
    # Next free id: a scalar subquery (evaluated once, shipped as a value).
    max_id = highest if highest is not None else snapshot.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    inserts = dense_ids(ch.filter(F.col("id").isNull()).drop("id"), max_id, "_seq").drop("_seq")
    for c in keep:
        if c != "id" and c not in inserts.columns:
            fresh = stamped if dated and c == "updated_at" else F.lit(None)
            inserts = inserts.withColumn(c, fresh.cast(dict(snapshot.dtypes)[c]))
    return updated.unionByName(inserts.select(*snapshot.columns))


def observations_delete(snapshot: DataFrame, ids: DataFrame) -> DataFrame:
    """K6: drop rows whose id is listed (anti join)."""
    return snapshot.join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_anti")


def observations_list(obs: DataFrame, category: str | None = None) -> DataFrame:
    """Rows of one category (all when blank), newest id first.

    With the table partitioned by category the filter prunes partitions.
    """
    df = obs.filter(F.col("category") == category.strip()) if category and category.strip() else obs
    return df.orderBy(F.desc("id"))


def with_category_title(obs: DataFrame) -> DataFrame:
    """Category code -> display title (unknown code -> itself)."""
    spark = obs.sparkSession
    titles = spark.createDataFrame(list(CATEGORY_TITLES.items()), "category string, category_title string")
    return obs.join(F.broadcast(titles), "category", "left").withColumn(
        "category_title", F.coalesce(F.col("category_title"), F.col("category"))
    )


def risk_flag(obs: DataFrame) -> DataFrame:
    """P12 (observation part): High / Critical risk types."""
    return obs.withColumn("HIGH_RISK", F.col("RiskType").isin("High", "Critical"))
