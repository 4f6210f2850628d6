"""Vendor-master change log (audit trail): P4-P6, W4, W9, A11-A18.

Normalisation (P5) is one projection of ``coalesce`` chains; the summaries
are single aggregations with ``count_if`` columns (map-side combined).
Header handling (P4) looks only at ``df.columns`` -- schema metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import audit_header_name, first_nonblank, safe_value, vendor_title_case

# Header aliases (normalised header -> target field).
AUDIT_TRAIL_ALIASES = {
    "process": "process", "module": "process", "category": "process",
    "control": "control", "controlname": "control", "controlid": "control",
    "status": "status", "statusname": "status",
    "owner": "owner", "assignedto": "owner", "responsibleowner": "owner",
    "department": "department", "team": "department",
    "remarks": "remarks", "comments": "remarks", "notes": "remarks",
}
# The 18 normalised output fields, in output order.
AUDIT_FIELDS = [
    "Process", "Control", "Status", "Owner", "Department", "Remarks",
    "VendorNo", "VendorName", "FieldChanged", "FieldDescription", "Indicator",
    "OldValue", "NewValue", "ChangedBy", "Risk", "Year", "Quantity", "MonthName",
]
# Stored column names of the audit-trail table (P6 adds the
# ones an older table lacks).
AUDIT_TABLE_COLUMNS = [
    "process", "control", "status", "owner", "department", "remarks",
    "vendor_no", "vendor_name", "field_changed", "field_description", "indicator",
    "old_value", "new_value", "changed_by", "risk", "year", "quantity", "month_name",
]
# The FieldChanged values counted per vendor, with their output names.
FIELD_COUNTS = [
    ("bankl", "banklCount"),
    ("financial services outsourcing", "financialServicesOutsourcingCount"),
    ("pan number", "panNumberCount"),
    ("services", "servicesCount"),
]
VENDOR_BUCKETS = ["HDFC", "Axis", "Qatar"]


def alias_headers(columns: list[str]) -> dict[str, str]:
    """Alias target -> source column; the last matching column wins."""
    found: dict[str, str] = {}
    for name in columns:
        key = audit_header_name(name)
        if key in AUDIT_TRAIL_ALIASES:
            found[AUDIT_TRAIL_ALIASES[key]] = name
    return found


def audit_trail_normalize(raw: DataFrame) -> DataFrame:
    """P5 (W9 is implied): 18 text fields from a change-log table with free headers.

    Missing source columns read as blank.  A present alias column (even if
    blank) suppresses the fallback chain of its field.  Both the workbook
    spellings ("Old Value") and the normalised ones ("OldValue") are read,
    so normalising twice is a no-op.
    """
    cols = set(raw.columns)
    aliases = alias_headers(raw.columns)
    sources = ["Vendor Name", "Vendor No", "VendorName", "VendorNo", "Field Changed", "FieldChanged",
               "Field Description", "FieldDescription", "Indicator", "Old Value", "OldValue", "New Value",
               "NewValue", "Changed By", "ChangedBy", "Risk", "Year", "Month Year", "Qty", "Quantity",
               "Month Name", "Month", "MonthName"]
    used = [n for n in sources if n in cols] + [a for a in aliases.values() if a not in sources]
    extra = [c for c in ("row_idx", "id") if c in cols]
    # Stage 1: clean every source column once.  Later stages reference the
    # cleaned attributes by name, so the fallback chains do not copy the
    # source expressions (which would blow up the generated code).
    names = {n: f"_s{i}" for i, n in enumerate(used)}
    stage1 = raw.select(*[safe_value(F.col(f"`{n}`")).alias(names[n]) for n in used], *extra)

    def v(*cands: str) -> Column:
        """First non-blank of the present candidate columns ('' if none)."""
        present = [F.col(names[n]) for n in cands if n in names]
        if not present:
            return F.lit("")
        return F.coalesce(first_nonblank(*present), F.lit(""))

    def aliased(target: str, chain: Column) -> Column:
        return F.col(names[aliases[target]]) if target in aliases else chain

    spec = {
        "Process": aliased("process", v("Vendor Name", "Vendor No")),
        "Control": aliased("control", v("Field Changed", "Field Description")),
        "Status": aliased("status", v("Indicator")),
        "Owner": aliased("owner", v("Changed By", "ChangedBy")),
        "Department": aliased("department", v("Risk")),
        "VendorNo": v("Vendor No", "VendorNo"),
        "VendorName": v("Vendor Name", "VendorName"),
        "FieldChanged": v("Field Changed", "FieldChanged"),
        "FieldDescription": v("Field Description", "FieldDescription"),
        "Indicator": v("Indicator"),
        "OldValue": v("Old Value", "OldValue"),
        "NewValue": v("New Value", "NewValue"),
        "ChangedBy": v("Changed By", "ChangedBy"),
        "Risk": v("Risk"),
        "Year": v("Year", "Month Year"),
        "Quantity": v("Qty", "Quantity"),
        "MonthName": v("Month Name", "Month", "MonthName"),
    }
    if "remarks" in aliases:
        remarks = F.col(names[aliases["remarks"]])
    else:
        remarks = safe_value(F.concat(v("Old Value", "OldValue"), F.lit(" -> "), v("New Value", "NewValue")))
    # Stage 2: the chains, over cleaned attributes.
    stage2 = stage1.select(*[c.alias(k) for k, c in spec.items()], remarks.alias("Remarks"), *extra)
    # Stage 3: defaults and the vendor spelling rule.
    out = []
    for name in AUDIT_FIELDS:
        c = F.col(name)
        if name == "Remarks":
            out.append(c)
        elif name == "VendorName":
            out.append(vendor_title_case(c).alias(name))
        else:
            out.append(F.when(c == "", F.lit("Unspecified")).otherwise(c).alias(name))
    # W9 (drop rows with no value) can never fire here: every field but
    # Remarks defaults to 'Unspecified'.  No filter is emitted -- pushed
    # below the projections it would inline all 18 chains into one predicate.
    return stage2.select(*out, *extra)


def schema_evolve(df: DataFrame, columns: list[str] = AUDIT_TABLE_COLUMNS, dtype: str = "string") -> DataFrame:
    """Add the listed columns an older table lacks (as nulls)."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(dtype) for c in missing}) if missing else df


def filter_audit_trail(audit: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """Equality on Year / Quantity / MonthName / VendorName (as text)."""
    preds = [F.col(k).cast("string") == str(val) for k, val in (filters or {}).items() if val not in (None, "")]
    return audit.filter(reduce(lambda a, b: a & b, preds)) if preds else audit


def _field_counts(fc: Column) -> list[Column]:
    return [F.count_if(fc == value).alias(name) for value, name in FIELD_COUNTS]


def audit_vendor_buckets(audit: DataFrame) -> DataFrame:
    """HDFC / Axis / Qatar buckets by name substring (first hit wins).

    grandTotal is the sum of the four counted fields; only the three named
    buckets are returned, with their display order in ``BUCKET_NO``.
    """
    # The lower-cased name and field are computed once, in their own
    # projection, and then tested by reference.
    keyed = audit.select(
        F.lower(F.trim(F.coalesce(F.col("VendorName"), F.lit("")))).alias("_name"),
        F.lower(F.trim(F.coalesce(F.col("FieldChanged"), F.lit("")))).alias("_fc"),
    )
    name = F.col("_name")
    bucket = (
        F.when(name.contains("hdfc"), F.lit("HDFC"))
        .when(name.contains("axis"), F.lit("Axis"))
        .when(name.contains("qatar"), F.lit("Qatar"))
        .otherwise(F.lit("Other"))
    )
    # The kept buckets are chosen by an aggregate: a filter on the key would be pushed below
    # the aggregation and repeat the whole chain of normalisations in every reference.
    g = keyed.groupBy(bucket.alias("_bucket")).agg(F.max(bucket).alias("vendorName"), *_field_counts(F.col("_fc")))
    total = reduce(lambda a, b: a + b, [F.col(n) for _, n in FIELD_COUNTS])
    return g.filter(F.col("vendorName").isin(VENDOR_BUCKETS)).select(
        "vendorName", *[n for _, n in FIELD_COUNTS], total.alias("grandTotal"),
        F.array_position(F.array(*[F.lit(b) for b in VENDOR_BUCKETS]), F.col("vendorName")).alias("BUCKET_NO"),
    )


def audit_vendor_summary(audit: DataFrame) -> DataFrame:
    """Per vendor name (blank dropped), in order of names: the four field counts and all rows."""
    keyed = audit.select(
        F.trim(F.coalesce(F.col("VendorName"), F.lit(""))).alias("vendorName"),
        F.lower(F.trim(F.coalesce(F.col("FieldChanged"), F.lit("")))).alias("_fc"),
    )
    return (
        keyed.groupBy(F.col("vendorName").alias("_vendor"))
        .agg(F.max("vendorName").alias("vendorName"), *_field_counts(F.col("_fc")), F.count(F.lit(1)).alias("grandTotal"))
        .filter(F.col("vendorName") != "").drop("_vendor").orderBy("vendorName")
    )


def audit_field_risk(audit: DataFrame) -> DataFrame:
    """Per field description (else field changed, else 'Unspecified'), in order: high / low risk."""
    desc = F.trim(F.coalesce(F.col("FieldDescription"), F.lit("")))
    changed = F.trim(F.coalesce(F.col("FieldChanged"), F.lit("")))
    key = F.when((desc == "") | (desc == "Unspecified"),
                 F.when(changed == "", F.lit("Unspecified")).otherwise(changed)).otherwise(desc)
    high = F.lower(F.trim(F.coalesce(F.col("Risk"), F.lit("")))) == "high"
    return audit.groupBy(key.alias("fieldDescription")).agg(
        F.count_if(high).alias("highRiskCount"),
        F.count_if(~high).alias("lowRiskCount"),
        F.count(F.lit(1)).alias("grandTotal"),
    ).orderBy("fieldDescription")


def audit_counts(audit: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column`` (Status, Owner)."""
    return audit.groupBy(F.col(column).alias("VALUE")).agg(F.count(F.lit(1)).alias("ROWS"))


def audit_total_rows(audit: DataFrame) -> DataFrame:
    """A16."""
    return audit.agg(F.count(F.lit(1)).alias("total_rows"))


def audit_facets(audit: DataFrame, columns: tuple[str, ...] = ("Year", "Quantity", "MonthName")) -> DataFrame:
    """Distinct non-blank values per facet column as (FACET, VALUE) rows (text order)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("FACET"), F.col(c).cast("string").alias("VALUE")) for c in columns])
    return (
        audit.select(F.explode(pairs).alias("p"))
        .select("p.FACET", "p.VALUE")
        .filter(F.col("VALUE").isNotNull() & (F.col("VALUE") != ""))
        .distinct()
    )


def audit_match_counts(audit: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """Rows matching the W4 filters / all rows, in one pass."""
    preds = [F.col(k).cast("string") == str(val) for k, val in (filters or {}).items() if val not in (None, "")]
    match = reduce(lambda a, b: a & b, preds) if preds else F.lit(True)
    return audit.agg(F.count_if(match).alias("matching_rows"), F.count(F.lit(1)).alias("all_rows"))


def audit_flags(audit: DataFrame) -> DataFrame:
    """P12 (audit part): high-risk rows and deleted / inserted indicators."""
    risk = F.lower(F.trim(F.col("Risk")))
    ind = F.col("Indicator")
    return audit.withColumn("HIGH_RISK", risk == "high").withColumn(
        "INDICATOR_FLAG",
        F.when(ind == "Deleted", F.lit("Deleted")).when(ind == "Inserted", F.lit("Inserted")).otherwise(F.lit("")),
    )
