"""Views that map the driver's TPC-H-style tables onto the audit data model.

These are the inputs every registered query reads (FIXTURES.md §3).  They
are plain DataFrame plans over the parquet tables, so column pruning and
predicate pushdown reach the scans, and the work grows with the tables.

Join strategy: lineitem ⋈ orders ⋈ customer ⋈ part are fact/large-dimension
joins and are left to Catalyst + AQE (sort-merge by default, converted to
broadcast at runtime only when the measured side is under
``spark.sql.autoBroadcastJoinThreshold``).  No side is force-broadcast
unless it is a literal table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import ALL_MONTHS, fiscal_year_label, round2

# The bank list payments are drawn from.
BANKS = ["HDFC Bank", "ICICI Bank", "SBI", "Axis Bank", "Kotak Bank"]
# The GST slabs products are assigned to (by p_size % 5).
GST_SLABS = [0, 5, 12, 18, 28]
# Fixed values for the audit-trail change log view.
AUDIT_VENDORS = ["hdfc bank limited", "axis bank", "QATAR BANK", "o'neil supplies"]
AUDIT_FIELDS = ["BANKL", "Financial Services Outsourcing", "PAN Number", "Services", "Address"]
# Loan types / locations of the loan-schedule view.
LOAN_TYPES = ["Home Loan", "Vehicle Loan", "Personal Loan", "Business Loan", "Education Loan"]
LOAN_LOCATIONS = ["Bangalore", "Mumbai", "Delhi", "Chennai", "Pune"]
# Employee master attributes of the HR view.
DEPARTMENTS = ["Finance", "HR", "IT", "Operations", "Sales"]
LOCATIONS = ["Bangalore", "Mumbai", "Delhi", "Chennai", "Pune", "Hyderabad", "Kolkata"]
# The customer market segments of the test data.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


# Schemas of the driver's tables; declared, so that no query reads footers for them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one input table, as its files are now."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    """values[index] for a 0-based integral index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# ---------------------------------------------------------------- V1 / V1c --
def purchase_source(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """V1 (or V1c when ``coarse``): invoice lines with the workbook's 20 columns.

    Extra columns: ``_ord`` (the order key), ``_line`` (the line's place in its
    invoice) and ``_nationkey`` (supplier nation, used by the bank-payment view).
    """
    li, placed, part_dim, supplier, nation, region = _purchase_inputs(spark, sf_dir, coarse)
    supp_geo = (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("s_suppkey", "s_nationkey", "n_name", "r_name")
    )
    # Orders and customers are joined before the lines, which are then shuffled once for both.
    df = (
        li.join(placed, li.l_orderkey == placed.o_orderkey)
        .join(part_dim, li.l_partkey == part_dim.p_partkey)
        .join(supp_geo, li.l_suppkey == supp_geo.s_suppkey)
    )
    return purchase_columns(df, coarse)


def _purchase_inputs(spark: SparkSession, sf_dir: str, coarse: bool) -> tuple[DataFrame, ...]:
    """What V1 joins: lines, placed orders, products, suppliers, nations, regions."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = table(spark, sf_dir, "part")

    # Dimension-side derivations: evaluated once per part / supplier rather
    # than once per line, and only the derived columns ride through the
    # fact-side shuffles.
    part_dim = part.select(
        "p_partkey",
        (F.col("p_type") if coarse else F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("product name"),
        F.when(F.col("p_partkey") % 97 == 0, F.lit(""))
        .otherwise(F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("product code"),
        _pick(GST_SLABS, F.col("p_size") % 5).cast("double").alias("slab_rate"),
    )
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return li, placed, part_dim, supplier, nation, region


def purchase_lines(spark: SparkSession, sf_dir: str, part: int = 0, parts: int = 1) -> DataFrame:
    """The joined rows that V1 is computed from (``purchase_columns``), or one of ``parts`` parts of them by order key.

    For a table to be written: what is derived takes no room in it.  The
    supplier's one number joins first and the orders last, so that each shuffle
    of the lines carries little and an invoice's lines lie together.
    """
    li, placed, part_dim, supplier, nation, region = _purchase_inputs(spark, sf_dir, coarse=False)
    if parts > 1:
        # Another hash than the shuffles' own, which deals a part's rows to all their partitions.
        li, placed = (df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part) for df, key in ((li, "l_orderkey"), (placed, "o_orderkey")))
    df = (
        li.join(supplier, li.l_suppkey == supplier.s_suppkey)
        .join(part_dim, li.l_partkey == part_dim.p_partkey)
        .join(placed, li.l_orderkey == placed.o_orderkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    return df.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "slab_rate", "product name",
        "product code", "c_mktsegment", "o_orderpriority", "o_orderdate", "s_nationkey", "n_name", "r_name",
    )


def purchase_columns(df: DataFrame, coarse: bool = False) -> DataFrame:
    """V1's columns (or V1c's) over its joined rows."""
    rate = (
        F.when((F.col("l_tax") == 0.08) & (F.col("l_suppkey") % 10 == 0), F.lit(28.0))
        .otherwise(F.col("slab_rate"))
    )
    # price × (1 − discount) on exact integer cents and percent: the exact
    # product divided once (correctly rounded) -- bit-identical to the
    # decimal(18,2) × decimal(4,2) result cast to double, without per-row
    # BigDecimal arithmetic.
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    pct = F.rint(F.col("l_discount") * 100).cast("bigint")
    net = (cents * (F.lit(100) - pct)).cast("double") / 10000.0
    gst = round2(net * rate / 100) + F.when(F.col("l_tax") == 0.08, F.lit(5.0)).otherwise(F.lit(0.0))
    if coarse:
        store_name = F.col("r_name")
        source = F.when(F.col("l_orderkey") % 2 == 0, F.lit("web")).otherwise(F.lit("store"))
    else:
        store_name = F.col("n_name")
        source = F.col("o_orderpriority")
    order_ts = F.col("o_orderdate").cast("timestamp")
    return df.select(
        F.col("l_orderkey").cast("string").alias("bill no"),
        F.col("l_suppkey").cast("string").alias("store code"),
        store_name.alias("store name"),
        F.col("c_mktsegment").alias("ordering channel"),
        source.alias("source"),
        F.col("r_name").alias("region"),
        F.col("`product code`"),
        F.col("`product name`"),
        (rate / 2).alias("product cgst rate"),
        (rate / 2).alias("product sgst rate"),
        (gst / 2).alias("product cgst amount"),
        (gst / 2).alias("product sgst amount"),
        net.alias("net sale"),
        (net + gst).alias("gross sale"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("item price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("marketing discount amount"),
        F.when(F.col("l_discount") == 0.10, F.lit(2.0)).otherwise(F.lit(0.0)).alias("loyalty discount amount"),
        order_ts.alias("bill date time"),
        order_ts.alias("business day date"),
        F.col("l_orderkey").alias("_ord"),
        F.col("l_linenumber").cast("long").alias("_line"),
        F.col("s_nationkey").alias("_nationkey"),
    )


def purchase_text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 as a loader gets it: every field is text, dates in many forms, some cells are no number or date.

    By order key modulo 13 the date is a serial, month-first, ISO with zone, a
    month's name, 'nan', a number out of range, a word, or has a year of two
    digits; modulo 17 the business day alone is null or blank, or the bill date
    alone is null; modulo 31 the rates are 'nan' or have a percent sign.  Store
    names have white space around them.
    """
    src = purchase_source(spark, sf_dir)
    k, day = F.col("_ord"), F.to_date("bill date time")
    forms = [
        F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"), F.date_format(day, "MM/dd/yyyy"),
        F.date_format(day, "yyyy-MM-dd'T10:00:00Z'"), F.date_format(day, "MMM d, yyyy"), F.date_format(day, "yyyy/MM/dd"),
        F.lit("nan"), F.lit("1e300"), F.lit("pending"), F.date_format(day, "dd-MMM-yyyy"),
        F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 10:05 pm")), F.date_format(day, "yyyy-MM-dd HH:mm:ss.SSS"),
        F.date_format(day, "M/d/yy"), F.concat(F.date_format(day, "d MMM yy"), F.lit(" 23:59:59.123")),
    ]
    date_text = _pick_column(forms, k % 13)
    day_text = F.when(k % 17 == 2, F.lit(None)).when(k % 17 == 3, F.lit(" ")).otherwise(date_text)
    rate = lambda c: F.when(k % 31 == 3, F.lit("nan")).when(k % 31 == 4, F.concat(c.cast("string"), F.lit("%"))).otherwise(c.cast("string"))
    changed = {
        "bill date time": F.when(k % 17 != 4, date_text), "business day date": day_text,
        "product cgst rate": rate(F.col("product cgst rate")), "product sgst rate": rate(F.col("product sgst rate")),
        "store name": F.concat(F.lit("\u00a0 "), F.col("store name"), F.lit("\t")),
    }
    return src.select(*[changed.get(c, F.col(f"`{c}`").cast("string") if not c.startswith("_") else F.col(c)).alias(c) for c in src.columns])


def _pick_column(columns: list[Column], index: Column) -> Column:
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, column in enumerate(columns):
        chosen = chosen.when(index == i, column)
    return chosen


# ------------------------------------------------------------------- V2 --
def recon_tables(invoices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V2: PO, GRN and bank-payment tables from the invoice rollup (A2).

    ``invoices`` has INVOICE_NO, COMP_NM, CUST_NM, INVOICE_AMT, MONTH, YEAR,
    ``_ord`` (order key) and ``_nationkey``.  Absence rules drop some
    invoices from each table so the reconciliation has real exceptions.
    """
    k = F.col("_ord")
    amt = F.col("INVOICE_AMT")
    po = invoices.filter(k % 7 != 0).select(
        F.concat(F.lit("PO-"), k.cast("string")).alias("PO_NO"),
        "INVOICE_NO", "COMP_NM", "CUST_NM",
        amt.alias("AMT"), "MONTH", "YEAR", k.alias("ORD"),
    )
    grn = invoices.filter(k % 5 != 0).select(
        F.concat(F.lit("GRN-"), k.cast("string")).alias("GRN_NO"),
        "INVOICE_NO", "COMP_NM", "CUST_NM",
        round2(amt * (F.lit(0.95) + (k % 11).cast("double") / 100)).alias("AMT"),
        k.alias("ORD"),
    )
    nk = F.col("_nationkey")
    bank = invoices.filter(k % 4 != 0).select(
        _pick(BANKS, (nk + k % (nk % 4 + 1)) % 5).alias("BANK"),
        "INVOICE_NO", "COMP_NM",
        (F.lit(15) + (k * 7) % 90).cast("int").alias("PAYMENT_DAYS"),
        round2(amt * (F.lit(0.96) + (k % 9).cast("double") / 100)).alias("AMT"),
        k.alias("ORD"),
    )
    return po, grn, bank


# ------------------------------------------------------------------- V3 --
def audit_trail_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: vendor-master change log with the workbook's text headers."""
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    ts = F.col("o_orderdate").cast("timestamp")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        ck.cast("string").alias("Vendor No"),
        _pick(AUDIT_VENDORS, ck % 4).alias("Vendor Name"),
        _pick(AUDIT_FIELDS, ok % 5).alias("Field Changed"),
        F.when(ok % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("Desc "), (ok % 6).cast("string")))
        .alias("Field Description"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Deleted"))
        .when(F.col("o_orderstatus") == "O", F.lit("Inserted"))
        .otherwise(F.lit("Updated")).alias("Indicator"),
        price.cast("string").alias("Old Value"),
        (price + (ok % 100)).cast("decimal(18,2)").cast("string").alias("New Value"),
        F.concat(F.lit("user"), (ck % 9).cast("string")).alias("Changed By"),
        F.when(ok % 13 == 0, F.lit(""))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("High"))
        .otherwise(F.lit("Low")).alias("Risk"),
        fiscal_year_label(ts).alias("Year"),
        ((ok % 10) + 1).cast("string").alias("Qty"),
        F.date_format(ts, "MMMM").alias("Month Name"),
        ok.alias("row_idx"),
    )


# ------------------------------------------------------------------- V4 --
# The 16 observation categories (11 control checks + 5 hygiene).
OBSERVATION_CATEGORIES = [
    "multi_tax", "prod_gst", "dup_cust", "prod_name", "prod_code",
    "itc_access_lwd", "itc_inactive_90", "itc_pwd_stale",
    "itc_after_hours", "itc_failed_login", "itc_above_limit",
    "hr_dup_bank", "hr_dup_pan_aadhaar", "hr_missing_ids",
    "hr_missing_master", "hr_same_pan",
]


def observations_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: an observation workbook (all 35 fields as text) plus ``row_idx``."""
    from ledgerlens.operators.observations import ALL_FIELDS

    o = table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    blank_row = ok % 50 == 0
    cat = (
        F.when(ok % 18 == 16, F.lit("bogus"))
        .when(ok % 18 == 17, F.lit(""))
        .otherwise(_pick(OBSERVATION_CATEGORIES, ok % 18))
    )
    ts = F.col("o_orderdate").cast("timestamp")
    values = {
        "category": cat,
        "table_name": F.concat(F.lit("Table "), (ok % 18).cast("string")),
        "entity_key": F.when(ok % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("EK-"), ok.cast("string"))),
        "ObservationTitle": F.when(ok % 7 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("Observation #"), ok.cast("string"), F.lit(" / "), F.col("o_orderpriority"))),
        "RiskType": F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Critical"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("High")).otherwise(F.lit("Low")),
        "Department": _pick(DEPARTMENTS, ok % 5),
        "RepeatObservation": F.when(ok % 2 == 0, F.lit("Yes")).otherwise(F.lit("No")),
        "TargetDate": F.date_format(ts, "yyyy-MM-dd"),
        "PercentageCompletedAuditee": (ok % 101).cast("string"),
        "Auditee": F.concat(F.lit("Auditee "), (F.col("o_custkey") % 13).cast("string")),
    }
    cols = []
    for field in ALL_FIELDS:
        v = values.get(field, F.concat(F.lit(field[:4] + "-"), (ok % 9).cast("string")))
        cols.append(F.when(blank_row, F.lit(None).cast("string")).otherwise(v).alias(field))
    return o.select(*cols, ok.alias("row_idx"))


# ------------------------------------------------------------------- V5 --
def remark_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: remark save/delete requests as an append-only change log."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id") % 40
    # The first five keys are real duplicate-customer issues (market
    # segments); the rest are issues no longer raised by the data.
    key = F.when(uid < 5, _pick(SEGMENTS, uid)).otherwise(F.concat(F.lit("U"), uid.cast("string")))
    return e.select(
        F.concat(F.lit("dup_cust:"), key).alias("issue_id"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("category"),
        F.concat(F.lit("E"), uid.cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("entity_key"),
        F.col("event_type").alias("remark"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 200), F.lit("delete"))
        .otherwise(F.lit("save")).alias("action"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


# ------------------------------------------------------------------- V6 --
def loan_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V6: (calc schedule, bank schedule, borrower meta).

    One schedule row per (order, line number); values in exact decimals.
    """
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    # Grouped by the final key, so that joins on it find the rows where they are.
    keyed = li.withColumns({"person": F.col("l_orderkey").cast("string"), "month": F.col("l_linenumber")})
    grouped = keyed.groupBy("person", "month").agg(
        F.sum(price).alias("opening"),
        F.sum(price * tax).alias("interest"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("principal"),
        F.max(tax).alias("rate"),
        F.min("l_suppkey").alias("min_supp"),
    )
    base = grouped.select(
        "person", "month",
        "opening", "interest", "principal", "rate", "min_supp",
    )

    def schedule(interest: Column) -> list[Column]:
        return [
            "person", "month",
            F.col("opening").cast("decimal(20,2)").alias("opening"),
            interest.cast("decimal(20,4)").alias("interest"),
            F.col("principal").cast("decimal(20,2)").alias("principal"),
            (interest + F.col("principal")).cast("decimal(20,4)").alias("emi"),
            (F.col("opening") - F.col("principal")).cast("decimal(20,2)").alias("closing"),
            F.col("rate").cast("decimal(6,4)").alias("rate"),
        ]

    # Some months are on one side only.
    calc = base.filter(F.col("min_supp") % 89 != 0).select(
        *schedule(F.col("interest")),
        F.when(F.col("min_supp") % 50 == 0, F.lit(400)).cast("decimal(20,2)").alias("other_charge"),
    )
    bank_interest = F.col("interest") + F.when(F.col("min_supp") % 50 == 0, F.lit(10)).otherwise(F.lit(0))
    bank = base.filter(F.col("min_supp") % 97 != 0).select(*schedule(bank_interest))
    k = F.col("l_orderkey")
    meta = (
        li.select("l_orderkey").distinct()
        .filter(k % 6 != 5)
        .select(
            k.cast("string").alias("person"),
            _pick(LOAN_TYPES, k % 5).alias("loan_type"),
            _pick(LOAN_LOCATIONS, k % 6).alias("location"),
        )
    )
    return calc, bank, meta


# ------------------------------------------------------------------- V7 --
def employees_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: employee master with shared / missing statutory ids."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tens = k - k % 10

    def shared(digits: tuple[int, int]) -> Column:
        return F.when((k % 10).isin(*digits), tens).otherwise(k)

    return c.select(
        k.alias("emp_id"),
        F.col("c_name").alias("name"),
        F.when(k % 31 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("5010"), F.lpad(shared((0, 3)).cast("string"), 10, "0"))).alias("bank_acct"),
        F.when(k % 17 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("PAN"), F.lpad(shared((1, 4)).cast("string"), 7, "0"))).alias("pan"),
        F.when(k % 29 == 0, F.lit(None))
        .otherwise(F.lpad(shared((2, 7)).cast("string"), 12, "0")).alias("aadhaar"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(_pick(DEPARTMENTS, k % 5)).alias("department"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(_pick(LOCATIONS, k % 7)).alias("location"),
        F.when(k % 23 == 0, F.lit(None)).otherwise(F.concat(F.lit("G"), ((k % 6) + 1).cast("string"))).alias("grade"),
    )


# ------------------------------------------------------------------- V8 --
def access_events_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: user access events (login, failed login, approval, password change)."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    kind = (
        F.when(et.isin("view", "click"), F.lit("login"))
        .when(et == "error", F.lit("failed_login"))
        .when(et == "purchase", F.lit("approval"))
        .when(et == "signup", F.lit("password_change"))
    )
    return e.select(
        F.col("user_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.col("value").alias("value"),
    )


def exits_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: last working day for leavers (every third user)."""
    e = table(spark, sf_dir, "events")
    return (
        e.select("user_id").distinct()
        .filter(F.col("user_id") % 3 == 0)
        .select("user_id", F.date_add(F.lit("2024-01-15").cast("date"), (F.col("user_id") % 15).cast("int")).alias("last_working_day"))
    )


def approval_limits_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: authorised approval limit per user."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id").distinct().select(
        "user_id", (F.lit(60.0) + F.lit(30.0) * (F.col("user_id") % 3)).alias("approval_limit")
    )


__all__ = [
    "ALL_MONTHS", "BANKS", "table", "purchase_source", "recon_tables", "audit_trail_source",
    "observations_source", "remark_log_source", "loan_sources", "employees_source",
    "access_events_source", "exits_source", "approval_limits_source", "OBSERVATION_CATEGORIES",
]


def observation_changes_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved observation forms -- updates by id (some ids absent) and new rows."""
    from ledgerlens.operators.observations import ALL_FIELDS

    ok = F.col("row_idx")  # the order key
    rows = observations_source(spark, sf_dir).filter((ok % 19 == 0) | (ok % 23 == 0))
    fields = [F.col(f) for f in ALL_FIELDS if f not in ("ObservationTitle", "RiskType")]
    return rows.select(
        F.when(ok % 19 == 0, (ok / 2).cast("long")).alias("id"),
        ok.alias("seq"),
        *fields,
        F.concat(F.lit("Revised #"), ok.cast("string")).alias("ObservationTitle"),
        F.lit("Critical").alias("RiskType"),
    )
