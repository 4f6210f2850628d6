"""Independent SQL oracle: the same queries written as DuckDB SQL.

Each entry is self-contained ANSI-ish SQL over the pre-registered parquet
views (lineitem, orders, ...).  The shared test-data views are CTE texts
composed below; they are written from the data-model rules, not generated
from the Spark plans.  Rounding uses ``round_even(x*100, 0)/100`` (identical
to NumPy / Java ``rint`` scaling) and money sums are exact decimals.
"""

from __future__ import annotations

# ------------------------------------------------------------ V1 / V1c --
def _purchase_src(coarse: bool) -> str:
    store_name = "r.r_name" if coarse else "n.n_name"
    product_name = "p.p_type" if coarse else "concat_ws(' ', p.p_name, p.p_type, p.p_brand)"
    source = "CASE WHEN l.l_orderkey % 2 = 0 THEN 'web' ELSE 'store' END" if coarse else "o.o_orderpriority"
    return f"""
  SELECT
    CAST(l.l_orderkey AS VARCHAR) AS bill_no,
    CAST(s.s_suppkey AS VARCHAR) AS store_code,
    {store_name} AS store_name,
    c.c_mktsegment AS ordering_channel,
    {source} AS source,
    r.r_name AS region,
    CASE WHEN p.p_partkey % 97 = 0 THEN '' ELSE p.p_brand || '-' || CAST(p.p_size AS VARCHAR) END AS product_code,
    {product_name} AS product_name,
    CAST(CASE WHEN l.l_tax = 0.08::DOUBLE AND l.l_suppkey % 10 = 0 THEN 28
              ELSE [0, 5, 12, 18, 28][(p.p_size % 5) + 1] END AS DOUBLE) AS rate,
    CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net,
    l.l_extendedprice AS ext, l.l_quantity AS qty, l.l_discount AS disc, l.l_tax AS tax,
    CAST(o.o_orderdate AS TIMESTAMP) AS odate,
    l.l_orderkey AS ord,
    l.l_linenumber AS line,
    s.s_nationkey AS nationkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey"""


def _enriched(coarse: bool) -> str:
    """P1 in SQL: unrounded derived measures per line."""
    return f"""
src AS ({_purchase_src(coarse)}
),
src2 AS (
  SELECT *,
    round_even(net * rate / 100 * 100, 0) / 100
      + CASE WHEN tax = 0.08::DOUBLE THEN 5.0 ELSE 0.0 END AS gst
  FROM src
),
enriched AS (
  SELECT
    bill_no, store_code, ord, line, nationkey,
    CASE WHEN store_name = '' THEN 'Unknown Store' ELSE store_name END AS COMP_NM,
    CASE WHEN region = '' THEN 'Unknown' ELSE region END AS COMP_STATE,
    CASE WHEN ordering_channel = '' THEN 'Unknown' ELSE ordering_channel END AS CUST_NM,
    CASE WHEN source = '' THEN 'Unknown' ELSE source END AS CUST_STATE,
    CASE WHEN product_name = '' THEN 'Unknown Product' ELSE product_name END AS PROD_NM,
    CASE WHEN product_code = '' THEN 'Unknown' ELSE product_code END AS PROD_CODE,
    strftime(odate, '%B') AS "MONTH",
    CAST(year(odate) AS INTEGER) AS "YEAR",
    rate / 2 + rate / 2 AS GST_RATE,
    CAST(round_even(rate / 2 * 100, 0) / 100 AS VARCHAR) || '% CGST, '
      || CAST(round_even(rate / 2 * 100, 0) / 100 AS VARCHAR) || '% SGST' AS TAX_DESC,
    net AS INVOICE_AMT,
    gst / 2 + gst / 2 AS GST_AMT,
    net + gst AS TOTAL_AMT,
    ext * disc + CASE WHEN disc = 0.10::DOUBLE THEN 2.0 ELSE 0.0 END AS DISCOUNT,
    ext / qty * qty - net AS CALC_DISCOUNT,
    (ext * disc + CASE WHEN disc = 0.10::DOUBLE THEN 2.0 ELSE 0.0 END) - (ext / qty * qty - net) AS DISC_DIFF
  FROM src2
)"""


def _r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def _purchases(coarse: bool = False) -> str:
    """P2 in SQL: the published purchase table (as CTE ``purchases``)."""
    return _enriched(coarse) + f""",
purchases AS (
  SELECT bill_no AS INVOICE_NO, COMP_NM, COMP_STATE, PROD_NM, PROD_CODE, CUST_NM, CUST_STATE,
    "MONTH", "YEAR", {_r2('GST_RATE')} AS GST_RATE, TAX_DESC,
    {_r2('INVOICE_AMT')} AS INVOICE_AMT, {_r2('GST_AMT')} AS GST_AMT, {_r2('TOTAL_AMT')} AS TOTAL_AMT,
    {_r2('DISCOUNT')} AS DISCOUNT, {_r2('CALC_DISCOUNT')} AS CALC_DISCOUNT, {_r2('DISC_DIFF')} AS DISC_DIFF,
    ord
  FROM enriched
)"""


def _rollup() -> str:
    """A1 over the coarse purchases (CTE ``rollup``)."""
    sums = ", ".join(
        f"{_r2(f'CAST(SUM(CAST({m} AS DECIMAL(18,2))) AS DOUBLE)')} AS {m}"
        for m in ["INVOICE_AMT", "GST_AMT", "TOTAL_AMT", "DISCOUNT", "CALC_DISCOUNT", "DISC_DIFF"]
    )
    return _purchases(coarse=True) + f""",
rollup AS (
  SELECT 'Aggregated purchase data' AS INVOICE_NO, COMP_NM, COMP_STATE, PROD_NM, CUST_NM, CUST_STATE,
    "MONTH", "YEAR", 0.0::DOUBLE AS GST_RATE, '' AS TAX_DESC, {sums}
  FROM purchases
  GROUP BY COMP_NM, COMP_STATE, PROD_NM, CUST_NM, CUST_STATE, "MONTH", "YEAR"
)"""


def _recon() -> str:
    """V2 in SQL: CTEs ``invoices``, ``po``, ``grn``, ``bank``."""
    return _enriched(False) + f""",
first_lines AS (
  SELECT bill_no AS INVOICE_NO,
    min({{'line': line, 'comp': COMP_NM, 'cust': CUST_NM, 'm': "MONTH", 'y': "YEAR", 'k': ord, 'nk': nationkey}}) AS f,
    {_r2('CAST(SUM(CAST(INVOICE_AMT AS DECIMAL(18,4))) AS DOUBLE)')} AS INVOICE_AMT
  FROM enriched GROUP BY bill_no
),
invoices AS (
  SELECT INVOICE_NO, f.comp AS COMP_NM, f.cust AS CUST_NM, f.m AS "MONTH", f.y AS "YEAR", INVOICE_AMT, f.k AS k, f.nk AS nk
  FROM first_lines
),
po AS (
  SELECT 'PO-' || CAST(k AS VARCHAR) AS PO_NO, INVOICE_NO, COMP_NM, CUST_NM, INVOICE_AMT AS AMT,
    "MONTH", "YEAR", k AS ORD
  FROM invoices WHERE k % 7 <> 0
),
grn AS (
  SELECT 'GRN-' || CAST(k AS VARCHAR) AS GRN_NO, INVOICE_NO, COMP_NM, CUST_NM,
    {_r2('INVOICE_AMT * (0.95::DOUBLE + CAST(k % 11 AS DOUBLE) / 100)')} AS AMT, k AS ORD
  FROM invoices WHERE k % 5 <> 0
),
bank AS (
  SELECT ['HDFC Bank', 'ICICI Bank', 'SBI', 'Axis Bank', 'Kotak Bank'][((nk + k % (nk % 4 + 1)) % 5) + 1] AS BANK,
    INVOICE_NO, COMP_NM, CAST(15 + (k * 7) % 90 AS INTEGER) AS PAYMENT_DAYS,
    {_r2('INVOICE_AMT * (0.96::DOUBLE + CAST(k % 9 AS DOUBLE) / 100)')} AS AMT, k AS ORD
  FROM invoices WHERE k % 4 <> 0
)"""


def _match(limit: str = "") -> str:
    """J1 in SQL (CTE ``match``)."""
    return _recon() + f""",
keys AS (
  SELECT INVOICE_NO FROM po UNION SELECT INVOICE_NO FROM grn UNION SELECT INVOICE_NO FROM bank
),
match AS (
  SELECT k.INVOICE_NO,
    COALESCE(p.COMP_NM, g.COMP_NM, b.COMP_NM, '-') AS COMP_NM,
    COALESCE(p.PO_NO, 'Missing') AS PO_NO, COALESCE(p.AMT, 0.0) AS PO_AMT,
    COALESCE(g.GRN_NO, 'Missing') AS GRN_NO, COALESCE(g.AMT, 0.0) AS GRN_AMT,
    COALESCE(b.BANK, 'Missing') AS BANK, COALESCE(b.AMT, 0.0) AS BANK_AMT,
    CASE WHEN g.INVOICE_NO IS NOT NULL AND b.INVOICE_NO IS NOT NULL THEN '✓ Match'
         WHEN g.INVOICE_NO IS NOT NULL OR b.INVOICE_NO IS NOT NULL THEN '⚠ Partial'
         ELSE '✗ Missing' END AS "MATCH",
    p."MONTH" AS "MONTH", p."YEAR" AS "YEAR"
  FROM keys k
  LEFT JOIN po p ON p.INVOICE_NO = k.INVOICE_NO
  LEFT JOIN grn g ON g.INVOICE_NO = k.INVOICE_NO
  LEFT JOIN bank b ON b.INVOICE_NO = k.INVOICE_NO
  {limit}
)"""


SQL: dict[str, str] = {}

SQL["purchases"] = "WITH " + _purchases() + """
SELECT INVOICE_NO, COMP_NM, COMP_STATE, PROD_NM, PROD_CODE, CUST_NM, CUST_STATE, "MONTH", "YEAR",
  GST_RATE, TAX_DESC, INVOICE_AMT, GST_AMT, TOTAL_AMT, DISCOUNT, CALC_DISCOUNT, DISC_DIFF
FROM purchases"""

SQL["gst_check"] = "WITH " + _purchases() + f""",
g AS (SELECT INVOICE_NO, INVOICE_AMT, GST_RATE, GST_AMT,
        {_r2('INVOICE_AMT * GST_RATE / 100')} AS EXPECTED_GST FROM purchases)
SELECT INVOICE_NO, INVOICE_AMT, GST_RATE, GST_AMT, EXPECTED_GST,
  {_r2('GST_AMT - EXPECTED_GST')} AS DIFF,
  CASE WHEN abs({_r2('GST_AMT - EXPECTED_GST')}) < 1 THEN 'OK' ELSE 'Error' END AS STATUS
FROM g"""

SQL["disc_check"] = "WITH " + _purchases() + """
SELECT INVOICE_NO, INVOICE_AMT, DISCOUNT, CALC_DISCOUNT, DISC_DIFF,
  CASE WHEN abs(DISC_DIFF) < 1 THEN 'OK' ELSE 'Error' END AS STATUS
FROM purchases"""

SQL["gst_check_summary"] = "WITH " + _purchases() + f"""
SELECT CASE WHEN abs({_r2('GST_AMT - ' + _r2('INVOICE_AMT * GST_RATE / 100'))}) < 1 THEN 'OK' ELSE 'Error' END AS STATUS,
  COUNT(*) AS "ROWS"
FROM purchases GROUP BY 1"""

SQL["purchase_rollup"] = "WITH " + _rollup() + "\nSELECT * FROM rollup"

SQL["blocked_vendors"] = "WITH " + _enriched(False) + f""",
stats AS (
  SELECT COMP_NM,
    CAST(SUM(CAST(DISCOUNT AS DECIMAL(18,4))) AS DOUBLE) AS disc,
    CAST(SUM(CAST(INVOICE_AMT AS DECIMAL(18,4))) AS DOUBLE) AS inv,
    arg_min(bill_no, ord) AS INV_NO
  FROM enriched GROUP BY COMP_NM
)
SELECT COMP_NM AS VENDOR, 'High discount ratio / unusual pricing' AS REASON, INV_NO,
  {_r2('inv')} AS AMT
FROM stats WHERE COMP_NM <> ''
ORDER BY CASE WHEN inv = 0 THEN 0.0 ELSE disc / inv END DESC, COMP_NM
LIMIT 4"""

SQL["dimension_values"] = "WITH " + _purchases() + """
SELECT DISTINCT * FROM (
  SELECT 'companies' AS DIMENSION, COMP_NM AS "VALUE" FROM purchases
  UNION ALL SELECT 'products', PROD_NM FROM purchases
  UNION ALL SELECT 'customers', CUST_NM FROM purchases
  UNION ALL SELECT 'states', COMP_STATE FROM purchases WHERE COMP_STATE <> '' AND COMP_STATE <> 'Unknown'
  UNION ALL SELECT 'states', unnest(['Bangalore', 'Mumbai', 'Delhi NCR', 'Hyderabad', 'Chennai', 'Kolkata', 'Pune', 'Ahmedabad'])
  UNION ALL SELECT 'months', unnest(['January', 'February', 'March', 'April', 'May', 'June', 'July',
                                     'August', 'September', 'October', 'November', 'December'])
) t"""

SQL["invoice_rollup"] = "WITH " + _recon() + """
SELECT INVOICE_NO, COMP_NM, CUST_NM, "MONTH", "YEAR", INVOICE_AMT FROM invoices"""

SQL["po"] = "WITH " + _recon() + "\nSELECT PO_NO, INVOICE_NO, COMP_NM, CUST_NM, AMT, \"MONTH\", \"YEAR\" FROM po"
SQL["grn"] = "WITH " + _recon() + "\nSELECT GRN_NO, INVOICE_NO, COMP_NM, CUST_NM, AMT FROM grn"
SQL["bank"] = "WITH " + _recon() + "\nSELECT BANK, INVOICE_NO, COMP_NM, PAYMENT_DAYS, AMT FROM bank"

SQL["invoice_universe"] = "WITH " + _recon() + """
SELECT INVOICE_NO FROM po UNION SELECT INVOICE_NO FROM grn UNION SELECT INVOICE_NO FROM bank"""

SQL["three_way_match"] = "WITH " + _match() + "\nSELECT * FROM match ORDER BY INVOICE_NO LIMIT 45"
SQL["three_way_match_full"] = "WITH " + _match() + "\nSELECT * FROM match"
SQL["match_counts"] = "WITH " + _match() + "\nSELECT \"MATCH\", COUNT(*) AS \"ROWS\" FROM match GROUP BY 1"

SQL["grn_without_invoice"] = "WITH " + _recon() + """
SELECT g.GRN_NO, g.INVOICE_NO, g.COMP_NM, g.CUST_NM, g.AMT
FROM grn g WHERE NOT EXISTS (SELECT 1 FROM po p WHERE p.INVOICE_NO = g.INVOICE_NO)
ORDER BY g.ORD, g.INVOICE_NO, g.GRN_NO LIMIT 15"""

SQL["open_po"] = "WITH " + _recon() + """
SELECT p.PO_NO, p.INVOICE_NO, p.COMP_NM, p.CUST_NM, p.AMT, p."MONTH", p."YEAR"
FROM po p WHERE NOT EXISTS (SELECT 1 FROM grn g WHERE g.INVOICE_NO = p.INVOICE_NO)
ORDER BY p.ORD, p.INVOICE_NO, p.PO_NO LIMIT 15"""

SQL["grn_without_invoice_count"] = "WITH " + _recon() + """
SELECT COUNT(*) AS "ROWS" FROM grn g WHERE NOT EXISTS (SELECT 1 FROM po p WHERE p.INVOICE_NO = g.INVOICE_NO)"""

SQL["open_po_count"] = "WITH " + _recon() + """
SELECT COUNT(*) AS "ROWS" FROM po p WHERE NOT EXISTS (SELECT 1 FROM grn g WHERE g.INVOICE_NO = p.INVOICE_NO)"""

SQL["bank_summary"] = "WITH " + _recon() + """
SELECT COMP_NM, CAST(COUNT(DISTINCT BANK) AS INTEGER) AS BANK_COUNT,
  array_to_string(list_sort(list(DISTINCT BANK)), ', ') AS BANKS
FROM bank GROUP BY COMP_NM"""

SQL["pay_summary"] = "WITH " + _recon() + """
SELECT COMP_NM, round_even(AVG(CAST(PAYMENT_DAYS AS DOUBLE)) * 10, 0) / 10 AS AVG_DAYS, COUNT(*) AS "COUNT",
  CASE WHEN round_even(AVG(CAST(PAYMENT_DAYS AS DOUBLE)) * 10, 0) / 10 > 60 THEN 'Slow' ELSE 'OK' END AS PAY_FLAG
FROM bank GROUP BY COMP_NM"""

SQL["po_kpis"] = "WITH " + _match() + f"""
SELECT COUNT(*) AS TOTAL_INVOICES,
  {_r2('CAST(SUM(CAST(CASE WHEN PO_AMT > 0 THEN PO_AMT ELSE 0.0 END AS DECIMAL(18,2))) AS DOUBLE)')} AS INVOICE_AMOUNT,
  {_r2('CAST(SUM(CAST(CASE WHEN GRN_AMT > 0 THEN GRN_AMT ELSE 0.0 END AS DECIMAL(18,2))) AS DOUBLE)')} AS GRN_AMOUNT,
  {_r2('CAST(SUM(CAST(CASE WHEN BANK_AMT > 0 THEN BANK_AMT ELSE 0.0 END AS DECIMAL(18,2))) AS DOUBLE)')} AS BANK_AMOUNT,
  {_r2('CAST(SUM(CAST(PO_AMT AS DECIMAL(18,2))) AS DOUBLE)')} AS TOTAL_PO_VALUE
FROM match"""


# -------------------------------------------------------------- hygiene --
def _numtext(x: str) -> str:
    return (f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


def _rate_list(list_expr: str) -> str:
    return f"array_to_string(list_transform(list_sort({list_expr}), lambda x: {_numtext('x')}), ', ')"


SQL["multi_tax"] = "WITH " + _enriched(False) + f"""
SELECT PROD_CODE,
  {_rate_list(f"list(DISTINCT {_r2('GST_RATE')})")} AS GST_RATE,
  array_to_string(list_sort(list(DISTINCT TAX_DESC) FILTER (WHERE TAX_DESC <> '')), ', ') AS TAX_DESC,
  COUNT(*) AS "COUNT"
FROM enriched GROUP BY PROD_CODE
HAVING COUNT(DISTINCT {_r2('GST_RATE')}) > 1 OR COUNT(DISTINCT TAX_DESC) FILTER (WHERE TAX_DESC <> '') > 1"""

SQL["dup_customers"] = "WITH " + _enriched(False) + """
SELECT COMP_NM AS CUST_NM,
  array_to_string(list_slice(list_sort(list(DISTINCT store_code) FILTER (WHERE store_code <> '')), 1, 3), ', ') AS CUST_CD,
  COUNT(*) AS "COUNT"
FROM enriched GROUP BY COMP_NM
HAVING COUNT(DISTINCT store_code) FILTER (WHERE store_code <> '') > 1"""

SQL["prod_name_issues"] = "WITH " + _enriched(False) + """
SELECT PROD_NM,
  array_to_string(list_slice(list_sort(list(DISTINCT PROD_CODE) FILTER (WHERE PROD_CODE <> '')), 1, 3), ', ') AS PROD_CODE,
  COUNT(*) AS "COUNT"
FROM enriched GROUP BY PROD_NM
HAVING COUNT(DISTINCT PROD_CODE) FILTER (WHERE PROD_CODE <> '') > 1"""

SQL["prod_gst_issues"] = "WITH " + _enriched(False) + f"""
SELECT PROD_NM, {_rate_list(f"list(DISTINCT {_r2('GST_RATE')})")} AS GST_RATE, COUNT(*) AS "COUNT"
FROM enriched GROUP BY PROD_NM
HAVING COUNT(DISTINCT {_r2('GST_RATE')}) > 1"""

SQL["prod_code_check"] = "WITH " + _enriched(False) + """
SELECT CASE WHEN PROD_CODE = '' THEN 'Unknown' ELSE PROD_CODE END AS PROD_CODE,
  CASE WHEN PROD_CODE = '' THEN 'Missing code' ELSE 'Multiple products' END AS STATUS
FROM enriched GROUP BY PROD_CODE
HAVING PROD_CODE = '' OR COUNT(DISTINCT PROD_NM) FILTER (WHERE PROD_NM <> '') > 1"""

_REMARK_LOG = """
log AS (
  SELECT 'dup_cust:' || CASE WHEN user_id % 40 < 5
           THEN ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][(user_id % 40) + 1]
           ELSE 'U' || CAST(user_id % 40 AS VARCHAR) END AS issue_id,
    'c' || CAST(event_id % 3 AS VARCHAR) AS category,
    'E' || CAST(user_id % 40 AS VARCHAR) || '-' || CAST(event_id % 5 AS VARCHAR) AS entity_key,
    event_type AS remark,
    CASE WHEN event_type = 'error' AND value > 200 THEN 'delete' ELSE 'save' END AS action,
    CAST(ts AS TIMESTAMP) AS ts, event_id AS seq
  FROM events
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY ts, seq) AS rn FROM log),
marked AS (
  SELECT *, max(CASE WHEN action = 'delete' THEN rn END) OVER (PARTITION BY issue_id) AS last_del FROM ranked
),
remarks AS (
  SELECT issue_id, arg_min(category, rn) AS category, arg_min(entity_key, rn) AS entity_key,
    arg_max(remark, rn) AS remark, max(ts) AS updated_at
  FROM marked WHERE action = 'save' AND rn > coalesce(last_del, 0)
  GROUP BY issue_id
)"""

SQL["remarks"] = "WITH " + _REMARK_LOG + """
SELECT issue_id, category, entity_key, remark, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM remarks"""


def _hygiene(body: str) -> str:
    """A filtered-hygiene CTE ``issues`` joined to remarks."""
    return "WITH " + _purchases() + "," + _REMARK_LOG + f""",
issues AS ({body})
SELECT i.*, coalesce(r.remark, '') AS REMARK FROM issues i LEFT JOIN remarks r ON r.issue_id = i.ISSUE_ID"""


_RATE_TXT = f"CASE WHEN GST_RATE = 0 THEN '' ELSE {_numtext('GST_RATE')} END"

SQL["hygiene_multi_tax"] = _hygiene(f"""
  SELECT 'multi_tax:' || PROD_CODE AS ISSUE_ID, 'multi_tax' AS CATEGORY, PROD_CODE AS ENTITY_KEY,
    {_rate_list("list(DISTINCT GST_RATE) FILTER (WHERE GST_RATE <> 0)")} AS GST_RATE,
    array_to_string(list_sort(list(DISTINCT TAX_DESC) FILTER (WHERE TAX_DESC <> '')), ', ') AS TAX_DESC,
    COUNT(*) AS "COUNT"
  FROM purchases GROUP BY PROD_CODE
  HAVING COUNT(DISTINCT GST_RATE) FILTER (WHERE GST_RATE <> 0) > 1
      OR COUNT(DISTINCT TAX_DESC) FILTER (WHERE TAX_DESC <> '') > 1""")

SQL["hygiene_prod_gst"] = _hygiene(f"""
  SELECT 'prod_gst:' || PROD_NM AS ISSUE_ID, 'prod_gst' AS CATEGORY, PROD_NM AS ENTITY_KEY, PROD_NM,
    {_rate_list("list(DISTINCT GST_RATE) FILTER (WHERE GST_RATE <> 0)")} AS GST_RATE,
    COUNT(*) AS "COUNT"
  FROM purchases GROUP BY PROD_NM
  HAVING COUNT(DISTINCT {_RATE_TXT}) > 1""")

SQL["hygiene_prod_name"] = _hygiene("""
  SELECT 'prod_name:' || PROD_NM AS ISSUE_ID, 'prod_name' AS CATEGORY, PROD_NM AS ENTITY_KEY, PROD_NM,
    array_to_string(list_sort(list(DISTINCT PROD_CODE)), ', ') AS PROD_CODE, COUNT(*) AS "COUNT"
  FROM purchases GROUP BY PROD_NM
  HAVING COUNT(DISTINCT PROD_CODE) > 1""")

SQL["hygiene_prod_code"] = _hygiene("""
  SELECT 'prod_code:' || PROD_CODE AS ISSUE_ID, 'prod_code' AS CATEGORY, PROD_CODE AS ENTITY_KEY, PROD_CODE,
    CASE WHEN PROD_CODE = 'Unknown' THEN 'Missing code' ELSE 'Multiple products' END AS STATUS
  FROM purchases GROUP BY PROD_CODE
  HAVING PROD_CODE = 'Unknown' OR COUNT(DISTINCT PROD_NM) > 1""")

SQL["hygiene_dup_cust"] = _hygiene("""
  SELECT 'dup_cust:' || CUST_NM AS ISSUE_ID, 'dup_cust' AS CATEGORY, CUST_NM AS ENTITY_KEY, CUST_NM,
    array_to_string(list_sort(list(DISTINCT CUST_STATE)), ', ') AS CUST_CD, COUNT(*) AS "COUNT"
  FROM purchases GROUP BY CUST_NM
  HAVING COUNT(DISTINCT CUST_STATE) > 1""")

SQL["hygiene_dup_cust_filtered_by_company"] = "WITH " + _purchases() + """
SELECT 'dup_cust:' || CUST_NM AS ISSUE_ID, 'dup_cust' AS CATEGORY, CUST_NM AS ENTITY_KEY, CUST_NM,
  array_to_string(list_sort(list(DISTINCT CUST_STATE)), ', ') AS CUST_CD, COUNT(*) AS "COUNT"
FROM purchases WHERE COMP_NM IN ('NATION_1', 'NATION_7', 'NATION_19')
GROUP BY CUST_NM HAVING COUNT(DISTINCT CUST_STATE) > 1"""


# ------------------------------------------------------------ dashboard --
_MS = "round_even(CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) * 100, 0) / 100"

SQL["monthly_purchase"] = "WITH " + _rollup() + f""",
months AS (SELECT unnest(['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August',
                          'September', 'October', 'November', 'December']) AS "MONTH",
                  CAST(unnest(range(1, 13)) AS INTEGER) AS MONTH_NO),
sums AS (SELECT "MONTH", {_MS.format(c='INVOICE_AMT')} AS PURCHASE FROM rollup GROUP BY "MONTH")
SELECT m."MONTH", m.MONTH_NO, coalesce(s.PURCHASE, 0.0) AS PURCHASE
FROM months m LEFT JOIN sums s ON s."MONTH" = m."MONTH" """


def _pie(dim: str) -> str:
    return "WITH " + _rollup() + f""",
top AS (
  SELECT CASE WHEN {dim} IS NULL OR {dim} = '' THEN 'Unknown' ELSE {dim} END AS LABEL,
    {_MS.format(c='INVOICE_AMT')} AS AMOUNT, COUNT(*) AS "ROWS"
  FROM rollup GROUP BY 1 ORDER BY AMOUNT DESC, LABEL LIMIT 8
)
SELECT LABEL, AMOUNT, "ROWS",
  floor(AMOUNT / CAST(SUM(CAST(AMOUNT AS DECIMAL(18,2))) OVER () AS DOUBLE) * 1000 + 0.5) / 10 AS SHARE_PCT
FROM top"""


SQL["pie_top8_company"] = _pie("COMP_NM")
SQL["pie_top8_product"] = _pie("PROD_NM")

SQL["month_trend"] = "WITH " + _rollup() + f"""
SELECT "MONTH",
  CAST(list_position(['April', 'May', 'June', 'July', 'August', 'September', 'October', 'November',
                      'December', 'January', 'February', 'March'], "MONTH") AS INTEGER) AS FISCAL_NO,
  {_MS.format(c='INVOICE_AMT')} AS AMOUNT, {_MS.format(c='GST_AMT')} AS GST, COUNT(*) AS "ROWS"
FROM rollup
WHERE "MONTH" IN ('April', 'May', 'June', 'July', 'August', 'September', 'October', 'November',
                  'December', 'January', 'February', 'March')
GROUP BY "MONTH" """

SQL["company_bar"] = "WITH " + _rollup() + f"""
SELECT COMP_NM, {_MS.format(c='INVOICE_AMT')} AS AMOUNT, COUNT(*) AS "ROWS", {_MS.format(c='GST_AMT')} AS GST,
  {_r2('CAST(SUM(CAST(INVOICE_AMT AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)')} AS AVG_AMOUNT
FROM rollup GROUP BY COMP_NM"""


def _kpis(where: str = "") -> str:
    return "WITH " + _rollup() + f"""
SELECT {_r2('CAST(coalesce(SUM(CAST(INVOICE_AMT AS DECIMAL(18,2))), 0) AS DOUBLE)')} AS TOTAL_AMOUNT,
  coalesce({_MS.format(c='GST_AMT')}, 0.0) AS TOTAL_GST,
  COUNT(DISTINCT COMP_NM) AS COMPANIES, COUNT(*) AS "ROWS",
  {_r2('CAST(coalesce(SUM(CAST(INVOICE_AMT AS DECIMAL(18,2))), 0) AS DOUBLE) / CASE WHEN COUNT(*) = 0 THEN 1 ELSE COUNT(*) END')} AS AVG_PER_ROW
FROM rollup {where}"""


SQL["ai_kpis"] = _kpis()
SQL["ai_kpis_filtered"] = _kpis("WHERE COMP_NM IN ('ASIA', 'EUROPE') AND \"MONTH\" IN ('January', 'February', 'March')")

SQL["purchase_register"] = "WITH " + _rollup() + """
SELECT INVOICE_NO, COMP_NM, PROD_NM, "YEAR", "MONTH", concat_ws(' ', "MONTH", CAST("YEAR" AS VARCHAR)) AS PERIOD,
  CUST_NM, INVOICE_AMT, GST_AMT, TOTAL_AMT
FROM rollup
ORDER BY COMP_NM NULLS FIRST, COMP_STATE NULLS FIRST, PROD_NM NULLS FIRST, CUST_NM NULLS FIRST,
  CUST_STATE NULLS FIRST, "MONTH" NULLS FIRST, "YEAR" NULLS FIRST
LIMIT 100"""


# ---------------------------------------------------------- audit trail --
_AUDIT = """
src AS (
  SELECT
    CAST(o_custkey AS VARCHAR) AS vendor_no,
    ['hdfc bank limited', 'axis bank', 'QATAR BANK', 'o''neil supplies'][(o_custkey % 4) + 1] AS vendor_name,
    ['BANKL', 'Financial Services Outsourcing', 'PAN Number', 'Services', 'Address'][(o_orderkey % 5) + 1] AS field_changed,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Desc ' || CAST(o_orderkey % 6 AS VARCHAR) END AS field_description,
    CASE o_orderstatus WHEN 'F' THEN 'Deleted' WHEN 'O' THEN 'Inserted' ELSE 'Updated' END AS indicator,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS old_value,
    CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + (o_orderkey % 100) AS DECIMAL(18,2)) AS VARCHAR) AS new_value,
    'user' || CAST(o_custkey % 9 AS VARCHAR) AS changed_by,
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderpriority = '1-URGENT' THEN 'High' ELSE 'Low' END AS risk,
    CASE WHEN month(o_orderdate) >= 4
         THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')
         ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0')
    END AS yr,
    CAST(o_orderkey % 10 + 1 AS VARCHAR) AS qty,
    strftime(o_orderdate, '%B') AS month_name,
    o_orderkey AS row_idx
  FROM orders
),
audit AS (
  SELECT
    coalesce(nullif(vendor_name, ''), nullif(vendor_no, ''), 'Unspecified') AS Process,
    coalesce(nullif(field_changed, ''), nullif(field_description, ''), 'Unspecified') AS Control,
    coalesce(nullif(indicator, ''), 'Unspecified') AS Status,
    coalesce(nullif(changed_by, ''), 'Unspecified') AS Owner,
    coalesce(nullif(risk, ''), 'Unspecified') AS Department,
    trim(old_value || ' -> ' || new_value) AS Remarks,
    coalesce(nullif(vendor_no, ''), 'Unspecified') AS VendorNo,
    CASE WHEN lower(vendor_name) = 'axis bank' THEN 'Axis Bank'
         WHEN lower(vendor_name) = 'qatar bank' THEN 'Qatar Bank'
         WHEN lower(vendor_name) = 'hdfc bank limited' THEN 'HDFC Bank Limited'
         WHEN vendor_name = '' OR vendor_name = 'Unspecified' THEN 'Unspecified'
         ELSE array_to_string(list_transform(regexp_extract_all(lower(vendor_name), '(\\p{L}+|[^\\p{L}]+)'),
                                             lambda w: upper(w[1]) || w[2:]), '')
    END AS VendorName,
    coalesce(nullif(field_changed, ''), 'Unspecified') AS FieldChanged,
    coalesce(nullif(field_description, ''), 'Unspecified') AS FieldDescription,
    coalesce(nullif(indicator, ''), 'Unspecified') AS Indicator,
    coalesce(nullif(old_value, ''), 'Unspecified') AS OldValue,
    coalesce(nullif(new_value, ''), 'Unspecified') AS NewValue,
    coalesce(nullif(changed_by, ''), 'Unspecified') AS ChangedBy,
    coalesce(nullif(risk, ''), 'Unspecified') AS Risk,
    coalesce(nullif(yr, ''), 'Unspecified') AS "Year",
    coalesce(nullif(qty, ''), 'Unspecified') AS Quantity,
    coalesce(nullif(month_name, ''), 'Unspecified') AS MonthName,
    row_idx
  FROM src
)"""

_FC = "lower(trim(FieldChanged))"
_FOUR = f"""count(*) FILTER (WHERE {_FC} = 'bankl') AS banklCount,
    count(*) FILTER (WHERE {_FC} = 'financial services outsourcing') AS financialServicesOutsourcingCount,
    count(*) FILTER (WHERE {_FC} = 'pan number') AS panNumberCount,
    count(*) FILTER (WHERE {_FC} = 'services') AS servicesCount"""

SQL["audit_trail"] = "WITH " + _AUDIT + "\nSELECT * FROM audit"

SQL["audit_vendor_buckets"] = "WITH " + _AUDIT + f""",
b AS (
  SELECT CASE WHEN lower(trim(VendorName)) LIKE '%hdfc%' THEN 'HDFC'
              WHEN lower(trim(VendorName)) LIKE '%axis%' THEN 'Axis'
              WHEN lower(trim(VendorName)) LIKE '%qatar%' THEN 'Qatar' ELSE 'Other' END AS vendorName,
    {_FOUR}
  FROM audit GROUP BY 1
)
SELECT vendorName, banklCount, financialServicesOutsourcingCount, panNumberCount, servicesCount,
  banklCount + financialServicesOutsourcingCount + panNumberCount + servicesCount AS grandTotal,
  CAST(CASE vendorName WHEN 'HDFC' THEN 1 WHEN 'Axis' THEN 2 ELSE 3 END AS INTEGER) AS BUCKET_NO
FROM b WHERE vendorName IN ('HDFC', 'Axis', 'Qatar')"""


def _vendor_summary(where: str = "") -> str:
    return "WITH " + _AUDIT + f"""
SELECT trim(VendorName) AS vendorName, {_FOUR}, COUNT(*) AS grandTotal
FROM audit WHERE trim(VendorName) <> '' {where}
GROUP BY 1"""


SQL["audit_vendor_summary"] = _vendor_summary()
SQL["audit_vendor_summary_filtered"] = _vendor_summary("AND \"Year\" = '1996-97' AND MonthName = 'March'")

SQL["audit_field_risk"] = "WITH " + _AUDIT + """
SELECT CASE WHEN trim(FieldDescription) = '' OR trim(FieldDescription) = 'Unspecified'
            THEN coalesce(nullif(trim(FieldChanged), ''), 'Unspecified') ELSE trim(FieldDescription) END AS fieldDescription,
  count(*) FILTER (WHERE lower(trim(Risk)) = 'high') AS highRiskCount,
  count(*) FILTER (WHERE lower(trim(Risk)) <> 'high') AS lowRiskCount,
  COUNT(*) AS grandTotal
FROM audit GROUP BY 1"""

SQL["audit_status_count"] = "WITH " + _AUDIT + "\nSELECT Status AS \"VALUE\", COUNT(*) AS \"ROWS\" FROM audit GROUP BY 1"
SQL["audit_owner_count"] = "WITH " + _AUDIT + "\nSELECT Owner AS \"VALUE\", COUNT(*) AS \"ROWS\" FROM audit GROUP BY 1"
SQL["audit_total_rows"] = "WITH " + _AUDIT + "\nSELECT COUNT(*) AS total_rows FROM audit"
SQL["audit_facets"] = "WITH " + _AUDIT + """
SELECT DISTINCT * FROM (
  SELECT 'Year' AS FACET, "Year" AS "VALUE" FROM audit
  UNION ALL SELECT 'Quantity', Quantity FROM audit
  UNION ALL SELECT 'MonthName', MonthName FROM audit
) t WHERE "VALUE" IS NOT NULL AND "VALUE" <> ''"""
SQL["audit_match_counts"] = "WITH " + _AUDIT + """
SELECT count(*) FILTER (WHERE "Year" = '1996-97' AND MonthName = 'March') AS matching_rows, COUNT(*) AS all_rows
FROM audit"""


# --------------------------------------------------------- observations --
_OBS_FIELDS = [
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
_OBS_CATS = ("['multi_tax', 'prod_gst', 'dup_cust', 'prod_name', 'prod_code', 'itc_access_lwd', "
             "'itc_inactive_90', 'itc_pwd_stale', 'itc_after_hours', 'itc_failed_login', 'itc_above_limit', "
             "'hr_dup_bank', 'hr_dup_pan_aadhaar', 'hr_missing_ids', 'hr_missing_master', 'hr_same_pan']")
_OBS_VALUES = {
    "category": f"CASE WHEN k % 18 = 16 THEN 'bogus' WHEN k % 18 = 17 THEN '' ELSE {_OBS_CATS}[(k % 18) + 1] END",
    "table_name": "'Table ' || CAST(k % 18 AS VARCHAR)",
    "entity_key": "CASE WHEN k % 3 = 0 THEN '' ELSE 'EK-' || CAST(k AS VARCHAR) END",
    "ObservationTitle": "CASE WHEN k % 7 = 0 THEN '' ELSE 'Observation #' || CAST(k AS VARCHAR) || ' / ' || o_orderpriority END",
    "RiskType": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' ELSE 'Low' END",
    "Department": "['Finance', 'HR', 'IT', 'Operations', 'Sales'][(k % 5) + 1]",
    "RepeatObservation": "CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END",
    "TargetDate": "strftime(o_orderdate, '%Y-%m-%d')",
    "PercentageCompletedAuditee": "CAST(k % 101 AS VARCHAR)",
    "Auditee": "'Auditee ' || CAST(o_custkey % 13 AS VARCHAR)",
}


def _obs_value(f: str) -> str:
    v = _OBS_VALUES.get(f, f"'{f[:4]}-' || CAST(k % 9 AS VARCHAR)")
    return f"CASE WHEN k % 50 = 0 THEN NULL ELSE {v} END AS {f}"


def _clean(f: str) -> str:
    return f"CASE WHEN lower(trim(coalesce({f}, ''))) = 'nan' THEN '' ELSE trim(coalesce({f}, '')) END AS {f}"


def _slug(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"


_ROWN = "'row-' || CAST(row_idx + 2 AS VARCHAR)"
_EKEY = (f"CASE WHEN entity_key <> '' THEN entity_key "
         f"WHEN {_slug(f'coalesce(nullif(ObservationTitle, {chr(39)}{chr(39)}), nullif(table_name, {chr(39)}{chr(39)}), {_ROWN})')} = '' "
         f"THEN {_ROWN} "
         f"ELSE {_slug(f'coalesce(nullif(ObservationTitle, {chr(39)}{chr(39)}), nullif(table_name, {chr(39)}{chr(39)}), {_ROWN})')} END")


def _obs(valid: str = _OBS_CATS) -> str:
    fields = ", ".join(_OBS_FIELDS)
    loaded_cols = ", ".join(_EKEY + " AS entity_key" if f == "entity_key" else f for f in _OBS_FIELDS)
    return f"""
obs_src AS (
  SELECT {', '.join(_obs_value(f) for f in _OBS_FIELDS)}, k AS row_idx
  FROM (SELECT *, o_orderkey AS k FROM orders) o
),
obs_clean AS (SELECT {', '.join(_clean(f) for f in _OBS_FIELDS)}, row_idx FROM obs_src),
obs_class AS (
  SELECT *, CASE WHEN concat({fields}) = '' THEN 'blank'
                 WHEN list_contains({valid}, category) THEN 'inserted' ELSE 'skipped' END AS outcome
  FROM obs_clean
),
loaded AS (SELECT {loaded_cols}, row_idx FROM obs_class WHERE outcome = 'inserted'),
snapshot AS (SELECT {fields}, row_number() OVER (ORDER BY row_idx) AS id FROM loaded)"""


_SEED = "['multi_tax', 'prod_gst', 'dup_cust', 'prod_name', 'prod_code']"

SQL["observations_loaded"] = "WITH " + _obs() + "\nSELECT * FROM loaded"
SQL["observations_seed"] = "WITH " + _obs(_SEED) + "\nSELECT * FROM loaded"
SQL["upload_accounting"] = "WITH " + _obs() + """
SELECT count(*) FILTER (WHERE outcome = 'inserted') AS inserted,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
  count(*) FILTER (WHERE outcome = 'blank') AS ignored_blank, COUNT(*) AS total
FROM obs_class"""
SQL["observations_list_dup_cust"] = "WITH " + _obs() + "\nSELECT * FROM snapshot WHERE category = 'dup_cust'"
SQL["observation_category_titles"] = "WITH " + _obs() + """,
titles(category, category_title) AS (VALUES
  ('multi_tax', 'Multiple Tax Code'), ('prod_gst', 'Same Product Multiple GST Rate'),
  ('dup_cust', 'Duplicate Customer Name'), ('prod_name', 'Product Name Check'),
  ('prod_code', 'Product Code Check'), ('itc_access_lwd', 'Access After Last Working Day'),
  ('itc_inactive_90', 'Users Not Logged In for 90+ Days'), ('itc_pwd_stale', 'Password Not Changed'),
  ('itc_after_hours', 'Login Outside Business Hours'), ('itc_failed_login', 'Multiple Failed Login Attempts'),
  ('itc_above_limit', 'Approved Above Authorized Limit'),
  ('hr_dup_bank', 'Multiple employees using same bank account'),
  ('hr_dup_pan_aadhaar', 'Duplicate PAN/Aadhaar/Bank Account'),
  ('hr_missing_ids', 'Missing PAN/Aadhaar/Bank Account'),
  ('hr_missing_master', 'Missing Department/Location/Grade'), ('hr_same_pan', 'Multiple employees with same PAN'))
SELECT s.category, coalesce(t.category_title, s.category) AS category_title, COUNT(*) AS "ROWS"
FROM snapshot s LEFT JOIN titles t ON t.category = s.category
GROUP BY 1, 2"""

_CHANGE_COLS = ", ".join(
    ("'Revised #' || CAST(row_idx AS VARCHAR) AS ObservationTitle" if f == "ObservationTitle"
     else "'Critical' AS RiskType" if f == "RiskType" else f)
    for f in _OBS_FIELDS
)
SQL["observations_upsert"] = "WITH " + _obs() + f""",
changes AS (
  SELECT CASE WHEN row_idx % 19 = 0 THEN row_idx // 2 END AS id, row_idx AS seq, {_CHANGE_COLS}
  FROM obs_src WHERE row_idx % 19 = 0 OR row_idx % 23 = 0
),
changes_clean AS (
  SELECT id, seq, {', '.join(f"coalesce(regexp_replace({f}, '^[[:space:]]+|[[:space:]]+$', '', 'g'), '') AS {f}" for f in _OBS_FIELDS)} FROM changes
),
last_update AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
                 FROM changes_clean WHERE id IS NOT NULL) t WHERE rn = 1
),
updated AS (
  SELECT {', '.join(f"coalesce(u.{f}, s.{f}) AS {f}" for f in _OBS_FIELDS)}, s.id
  FROM snapshot s LEFT JOIN last_update u ON u.id = s.id
),
inserted AS (
  SELECT {', '.join(_OBS_FIELDS)},
    (SELECT coalesce(max(id), 0) FROM snapshot) + row_number() OVER (ORDER BY seq) AS id
  FROM changes_clean WHERE id IS NULL
)
SELECT * FROM updated UNION ALL SELECT * FROM inserted"""

SQL["observations_delete"] = "WITH " + _obs() + """
SELECT * FROM snapshot WHERE id NOT IN (SELECT o_orderkey // 3 FROM orders WHERE o_orderkey % 17 = 0)"""


# ----------------------------------------------------------------- loans --
_LOANS = """
li_g AS (
  SELECT l_orderkey, l_linenumber,
    SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS opening,
    SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS interest,
    SUM(CAST(l_quantity AS DECIMAL(18,2))) AS principal,
    MAX(CAST(l_tax AS DECIMAL(4,2))) AS rate,
    MIN(l_suppkey) AS min_supp
  FROM lineitem GROUP BY l_orderkey, l_linenumber
),
calc AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS person, l_linenumber AS "month", opening, interest, principal,
    interest + principal AS emi, opening - principal AS closing, rate,
    CASE WHEN min_supp % 50 = 0 THEN 400 END AS other_charge
  FROM li_g WHERE min_supp % 89 <> 0
),
bank AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS person, l_linenumber AS "month", opening,
    interest + CASE WHEN min_supp % 50 = 0 THEN 10 ELSE 0 END AS interest, principal,
    interest + CASE WHEN min_supp % 50 = 0 THEN 10 ELSE 0 END + principal AS emi,
    opening - principal AS closing, rate
  FROM li_g WHERE min_supp % 97 <> 0
),
diff AS (
  SELECT coalesce(c.person, b.person) AS person, coalesce(c."month", b."month") AS "month",
    CAST(c.opening AS DOUBLE) AS calc_opening, CAST(c.interest AS DOUBLE) AS calc_interest,
    CAST(c.principal AS DOUBLE) AS calc_principal, CAST(c.emi AS DOUBLE) AS calc_emi,
    CAST(c.closing AS DOUBLE) AS calc_closing, CAST(c.rate AS DOUBLE) AS calc_rate,
    CAST(c.other_charge AS DOUBLE) AS other_charge,
    CAST(b.opening AS DOUBLE) AS bank_opening, CAST(b.interest AS DOUBLE) AS bank_interest,
    CAST(b.principal AS DOUBLE) AS bank_principal, CAST(b.emi AS DOUBLE) AS bank_emi,
    CAST(b.closing AS DOUBLE) AS bank_closing, CAST(b.rate AS DOUBLE) AS bank_rate,
    CAST(coalesce(b.opening - c.opening, 0) AS DOUBLE) AS diff_opening,
    CAST(coalesce(b.interest - c.interest, 0) AS DOUBLE) AS diff_interest,
    CAST(coalesce(b.principal - c.principal, 0) AS DOUBLE) AS diff_principal,
    CAST(coalesce(b.emi - c.emi, 0) AS DOUBLE) AS diff_emi,
    CAST(coalesce(b.closing - c.closing, 0) AS DOUBLE) AS diff_closing,
    CAST(coalesce(b.rate - c.rate, 0) AS DOUBLE) AS diff_rate
  FROM calc c FULL OUTER JOIN bank b ON b.person = c.person AND b."month" = c."month"
),
diff2 AS (
  SELECT *, (diff_opening <> 0 OR diff_interest <> 0 OR diff_principal <> 0 OR diff_emi <> 0
             OR diff_closing <> 0 OR diff_rate <> 0 OR (calc_opening IS NULL) <> (bank_opening IS NULL)) AS DIFF_HIT
  FROM diff
),
meta AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS person,
    ['Home Loan', 'Vehicle Loan', 'Personal Loan', 'Business Loan', 'Education Loan'][(l_orderkey % 5) + 1] AS loan_type,
    ['Bangalore', 'Mumbai', 'Delhi', 'Chennai', 'Pune'][(l_orderkey % 6) + 1] AS location
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) t WHERE l_orderkey % 6 <> 5
)"""

SQL["loan_diff"] = "WITH " + _LOANS + "\nSELECT * FROM diff2"
SQL["loan_diff_hits"] = "WITH " + _LOANS + """
SELECT person, "month", diff_opening, diff_interest, diff_principal, diff_emi, diff_closing, diff_rate, other_charge
FROM diff2 WHERE DIFF_HIT"""
SQL["loan_filtered"] = "WITH " + _LOANS + """
SELECT d.person, d."month", m.loan_type, m.location, d.diff_interest, d.DIFF_HIT
FROM diff2 d JOIN meta m ON m.person = d.person
WHERE m.loan_type = 'Home Loan' AND m.location = 'Mumbai'"""


# -------------------------------------------------------------- controls --
def _shared_id(x: str, digits: str) -> str:
    return f"CAST(CASE WHEN c_custkey % 10 IN {digits} THEN c_custkey - c_custkey % 10 ELSE c_custkey END AS VARCHAR)"


_EMP = f"""
emp AS (
  SELECT c_custkey AS emp_id, c_name AS name,
    CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE '5010' || lpad({_shared_id('c_custkey', '(0, 3)')}, 10, '0') END AS bank_acct,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'PAN' || lpad({_shared_id('c_custkey', '(1, 4)')}, 7, '0') END AS pan,
    CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE lpad({_shared_id('c_custkey', '(2, 7)')}, 12, '0') END AS aadhaar,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE ['Finance', 'HR', 'IT', 'Operations', 'Sales'][(c_custkey % 5) + 1] END AS department,
    CASE WHEN c_custkey % 19 = 0 THEN NULL
         ELSE ['Bangalore', 'Mumbai', 'Delhi', 'Chennai', 'Pune', 'Hyderabad', 'Kolkata'][(c_custkey % 7) + 1] END AS location,
    CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'G' || CAST(c_custkey % 6 + 1 AS VARCHAR) END AS grade
  FROM customer
),
ids AS (
  SELECT 'PAN' AS PARTICULARS, pan AS "VALUE", emp_id, name FROM emp WHERE pan IS NOT NULL AND trim(pan) <> ''
  UNION ALL SELECT 'Aadhaar', aadhaar, emp_id, name FROM emp WHERE aadhaar IS NOT NULL AND trim(aadhaar) <> ''
  UNION ALL SELECT 'Bank Account', bank_acct, emp_id, name FROM emp WHERE bank_acct IS NOT NULL AND trim(bank_acct) <> ''
),
shared AS (
  SELECT PARTICULARS, "VALUE", COUNT(DISTINCT emp_id) AS EMPLOYEES FROM ids GROUP BY 1, 2 HAVING COUNT(DISTINCT emp_id) > 1
)"""

SQL["hr_dup_bank"] = "WITH " + _EMP + """
SELECT i."VALUE" AS BANK_ACCT, i.emp_id, i.name, s.EMPLOYEES
FROM ids i JOIN shared s ON s.PARTICULARS = i.PARTICULARS AND s."VALUE" = i."VALUE" WHERE i.PARTICULARS = 'Bank Account'"""
SQL["hr_same_pan"] = "WITH " + _EMP + """
SELECT i."VALUE" AS PAN, i.emp_id, i.name, s.EMPLOYEES
FROM ids i JOIN shared s ON s.PARTICULARS = i.PARTICULARS AND s."VALUE" = i."VALUE" WHERE i.PARTICULARS = 'PAN'"""
SQL["hr_dup_statutory_ids"] = "WITH " + _EMP + """
SELECT i.PARTICULARS, i."VALUE", i.emp_id, i.name, s.EMPLOYEES
FROM ids i JOIN shared s ON s.PARTICULARS = i.PARTICULARS AND s."VALUE" = i."VALUE" """
SQL["hr_missing_ids"] = "WITH " + _EMP + """
SELECT emp_id, name, 'PAN' AS MISSING FROM emp WHERE pan IS NULL OR trim(pan) = ''
UNION ALL SELECT emp_id, name, 'Aadhaar' FROM emp WHERE aadhaar IS NULL OR trim(aadhaar) = ''
UNION ALL SELECT emp_id, name, 'Bank Account' FROM emp WHERE bank_acct IS NULL OR trim(bank_acct) = ''"""
SQL["hr_missing_master"] = "WITH " + _EMP + """
SELECT emp_id, name, 'Department' AS MISSING FROM emp WHERE department IS NULL OR trim(department) = ''
UNION ALL SELECT emp_id, name, 'Location' FROM emp WHERE location IS NULL OR trim(location) = ''
UNION ALL SELECT emp_id, name, 'Grade' FROM emp WHERE grade IS NULL OR trim(grade) = ''"""

_ACC = """
acc AS (
  SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, value,
    CASE WHEN event_type IN ('view', 'click') THEN 'login' WHEN event_type = 'error' THEN 'failed_login'
         WHEN event_type = 'purchase' THEN 'approval' WHEN event_type = 'signup' THEN 'password_change' END AS kind
  FROM events
)"""

SQL["itc_access_after_lwd"] = "WITH " + _ACC + """,
exits AS (
  SELECT user_id, CAST(DATE '2024-01-15' + CAST(user_id % 15 AS INTEGER) AS DATE) AS last_working_day
  FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 3 = 0
),
last AS (SELECT user_id, CAST(max(ts) AS DATE) AS last_access_date FROM acc WHERE kind = 'login' GROUP BY 1)
SELECT e.user_id, e.last_working_day, l.last_access_date,
  CAST(date_diff('day', e.last_working_day, l.last_access_date) AS INTEGER) AS DAYS_AFTER_LWD
FROM exits e JOIN last l ON l.user_id = e.user_id
WHERE date_diff('day', e.last_working_day, l.last_access_date) >= 1"""


def _since(kind: str, name: str) -> str:
    return "WITH " + _ACC + f""",
last AS (SELECT user_id, CAST(max(ts) AS DATE) AS last_date FROM acc WHERE kind = '{kind}' GROUP BY 1)
SELECT user_id, last_date, CAST(date_diff('day', last_date, DATE '2024-04-29') AS INTEGER) AS {name}
FROM last WHERE date_diff('day', last_date, DATE '2024-04-29') >= 91"""


SQL["itc_inactive_90"] = _since("login", "DAYS_NOT_LOGGED_IN")
SQL["itc_password_stale"] = _since("password_change", "DAYS_SINCE_PWD_CHANGE")
SQL["itc_after_hours"] = "WITH " + _ACC + """
SELECT user_id, COUNT(*) AS AFTER_HOURS_LOGINS FROM acc
WHERE kind = 'login' AND (hour(ts) < 9 OR hour(ts) >= 18)
GROUP BY 1 HAVING COUNT(*) >= 1"""
SQL["itc_failed_logins"] = "WITH " + _ACC + """
SELECT user_id, count(*) FILTER (WHERE kind = 'failed_login') AS FAILED_LOGINS FROM acc
GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'failed_login') >= 5"""
SQL["itc_above_limit"] = "WITH " + _ACC + """,
limits AS (SELECT user_id, 60.0 + 30.0 * (user_id % 3) AS approval_limit FROM (SELECT DISTINCT user_id FROM events) u)
SELECT a.user_id, count(*) FILTER (WHERE a.value > l.approval_limit) AS ABOVE_LIMIT
FROM acc a JOIN limits l ON l.user_id = a.user_id WHERE a.kind = 'approval'
GROUP BY 1 HAVING count(*) FILTER (WHERE a.value > l.approval_limit) >= 3"""

SQL["three_way_match_filtered"] = "WITH " + _match() + """
SELECT * FROM match WHERE COMP_NM IN ('NATION_3', 'NATION_11') AND "MONTH" IN ('April', 'May', 'June')"""

# ------------------------------------- the loader's text, flags and displays --
# The text of V1: what is no date counts as no month, what is no number as 0.
SQL["purchases_text"] = "WITH " + _purchases() + """
SELECT INVOICE_NO, COMP_NM, COMP_STATE, PROD_NM, PROD_CODE, CUST_NM, CUST_STATE,
  CASE WHEN ord % 13 IN (5, 6, 7) OR ord % 17 IN (2, 3) THEN 'Unknown' ELSE "MONTH" END AS "MONTH",
  CAST(CASE WHEN ord % 13 IN (5, 6, 7) OR ord % 17 IN (2, 3) THEN 0 ELSE "YEAR" END AS INTEGER) AS "YEAR",
  CASE WHEN ord % 31 IN (3, 4) THEN 0.0::DOUBLE ELSE GST_RATE END AS GST_RATE,
  CASE WHEN ord % 31 IN (3, 4) THEN '0.0% CGST, 0.0% SGST' ELSE TAX_DESC END AS TAX_DESC,
  INVOICE_AMT, GST_AMT, TOTAL_AMT, DISCOUNT, CALC_DISCOUNT, DISC_DIFF
FROM purchases"""
SQL["remarks_incremental"] = SQL["remarks"]
SQL["three_way_diff"] = f"""
SELECT *, CASE WHEN GRN_AMT = 0 OR BANK_AMT = 0 THEN NULL ELSE {_r2('GRN_AMT - BANK_AMT')} END AS DIFF,
  CASE WHEN GRN_AMT = 0 OR BANK_AMT = 0 THEN 'Missing' ELSE 'OK' END AS DIFF_STATUS
FROM ({SQL['three_way_match_full']}) m"""
SQL["multi_tax_flags"] = f"SELECT *, COUNT > 30 AS RISK_FLAG FROM ({SQL['multi_tax']}) m"
SQL["prod_name_flags"] = f"SELECT *, COUNT <= 3 AS RISK_FLAG FROM ({SQL['prod_name_issues']}) m"
SQL["dup_cust_flags"] = f"SELECT *, COUNT = 1 AS RISK_FLAG FROM ({SQL['dup_customers']}) m"
SQL["bank_flags"] = f"SELECT *, BANK_COUNT > 2 AS RISK_FLAG FROM ({SQL['bank_summary']}) m"
SQL["hygiene_export_multi_tax"] = f"""
SELECT GST_RATE AS "GST Rate (%)", TAX_DESC AS "Tax Description", COUNT AS "Count", REMARK AS "Remark"
FROM ({SQL['hygiene_multi_tax']}) m"""
SQL["observations_other_headers"] = SQL["observations_loaded"]

_SECOND_LOAD = f"""
second AS (SELECT * FROM loaded WHERE category IN ('multi_tax', 'hr_dup_bank') AND row_idx % 2 = 0),
fresh AS (SELECT {', '.join(_OBS_FIELDS)}, (SELECT max(id) FROM snapshot) + row_number() OVER (ORDER BY row_idx) AS id,
  '2024-02-01' AS updated_at FROM second)"""
SQL["observations_replaced"] = "WITH " + _obs() + "," + _SECOND_LOAD + """
SELECT *, '2024-01-01' AS updated_at FROM snapshot WHERE category NOT IN (SELECT category FROM second)
UNION ALL SELECT * FROM fresh"""
SQL["observations_seeded"] = "WITH " + _obs() + "," + _SECOND_LOAD + """
SELECT *, '2024-01-01' AS updated_at FROM snapshot UNION ALL SELECT * FROM fresh"""
SQL["observations_upsert_dated"] = SQL["observations_upsert"].replace(
    "SELECT * FROM updated UNION ALL SELECT * FROM inserted",
    "SELECT *, CASE WHEN id IN (SELECT id FROM last_update) THEN '2024-03-01' ELSE '2024-01-01' END AS updated_at FROM updated "
    "UNION ALL SELECT *, '2024-03-01' AS updated_at FROM inserted")

# ---------------------------------------------------- state, storage, sources --
SQL["remarks_streamed"] = SQL["remarks"]
SQL["stored_match_full"] = SQL["three_way_match_full"]
SQL["observations_upsert_parted"] = SQL["observations_upsert"]
SQL["observations_delete_parted"] = SQL["observations_delete"]


def _chunks(category: str, key: str, code: str, listed: str, size: int) -> str:
    return "WITH " + _purchases() + f""",
pairs AS (SELECT {key} AS k, {code} AS code, COUNT(*) AS n FROM purchases GROUP BY ALL),
placed AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY k ORDER BY code) - 1) // {size} AS chunk FROM pairs),
totals AS (SELECT k, COUNT(*) AS codes, CAST(SUM(n) AS BIGINT) AS total FROM pairs GROUP BY k HAVING COUNT(*) > 1)
SELECT '{category}:' || k AS ISSUE_ID, '{category}' AS CATEGORY, k AS ENTITY_KEY, k AS {key}, chunk AS CHUNK,
  string_agg(code, ', ' ORDER BY code) AS {listed}, ANY_VALUE(codes) AS CODES, ANY_VALUE(total) AS "COUNT"
FROM placed JOIN totals USING (k) GROUP BY k, chunk"""


SQL["hygiene_prod_name_chunks"] = _chunks("prod_name", "PROD_NM", "PROD_CODE", "PROD_CODE", 5)
SQL["hygiene_dup_cust_chunks"] = _chunks("dup_cust", "CUST_NM", "CUST_STATE", "CUST_CD", 2)
SQL["published_tables"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS "TABLE", COUNT(*) AS "ROWS" FROM ({SQL[name]}) t""" for name in (
        "purchases", "po", "grn", "bank", "blocked_vendors", "multi_tax", "dup_customers", "prod_name_issues", "prod_gst_issues",
        "prod_code_check", "gst_check", "disc_check"))


# ------------------------------------------------- displays, headers, reports --
def _whole(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT)"


def _grouped(n: str) -> str:
    """Digits in threes, then in twos: from the right, so on the reversed text."""
    rev = f"reverse(CAST(abs({n}) AS VARCHAR))"
    return f"CASE WHEN {n} < 0 THEN '-' ELSE '' END || reverse({rev}[1:3] || regexp_replace({rev}[4:], '([0-9]{{1,2}})', ',\\1', 'g'))"


def _inr(x: str) -> str:
    return f"'₹' || {_grouped(_whole(f'coalesce({x}, 0)'))}"


def _inr_short(x: str) -> str:
    n = _whole(x)
    return f"""CASE WHEN abs({n}) >= 10000000 THEN '₹' || printf('%.2f', {n} / 1e7) || ' Cr'
    WHEN abs({n}) >= 100000 THEN '₹' || printf('%.2f', {n} / 1e5) || ' L' ELSE {_inr(x)} END"""


SQL["display_amounts"] = f"""
SELECT COMP_NM, replace(lower(COMP_NM), ' ', '-') || '-private-ltd' AS SLUG, {_inr('AMOUNT')} AS "FULL", {_inr_short('AMOUNT')} AS "SHORT",
  '₹' || regexp_replace(printf('%.2f', {_whole('AMOUNT')} / 1e7), '\\.00$', '') || ' Cr' AS CRORE,
  {_inr_short('AVG_AMOUNT')} AS AVERAGE, CAST({_whole('GST / AMOUNT * 100')} AS VARCHAR) || '%' AS GST_SHARE,
  COMP_NM || ', ' || CAST("ROWS" AS VARCHAR) AS LISTED
FROM ({SQL['company_bar']}) t"""
SQL["multi_tax_percent"] = f"""
SELECT PROD_CODE, array_to_string(list_transform(string_split(GST_RATE, ', '), lambda r: r || '%'), ', ') AS RATES, COUNT
FROM ({SQL['multi_tax']}) t"""


def _loan_texts() -> str:
    def percent(x: str) -> str:
        return f"CAST({_whole(f'CAST(coalesce({x}, 0) AS DOUBLE) * 100')} AS VARCHAR) || '%'"

    measures = ["opening", "interest", "principal", "emi", "closing", "rate"]
    cols = [f"CASE WHEN {side}_{m} IS NULL THEN '—' ELSE {percent(f'{side}_{m}') if m == 'rate' else _inr(f'{side}_{m}')} END AS {side}_{m}_text"
            for side in ("calc", "bank") for m in measures]
    cols += [f"{percent(f'diff_{m}') if m == 'rate' else _inr(f'diff_{m}')} AS diff_{m}_text" for m in measures]
    return ", ".join(cols)


SQL["loan_display"] = f"SELECT person, month, {_loan_texts()}, DIFF_HIT FROM ({SQL['loan_diff']}) t"
# Labels and columns of the reports, as SURVEY's K8 has them.
_LAYOUTS = {
    "multi_tax": {"GST Rate (%)": "GST_RATE", "Tax Description": "TAX_DESC", "Count": "COUNT", "Remark": "REMARK"},
    "prod_gst": {"Product Name": "PROD_NM", "GST Rate (%)": "GST_RATE", "Count": "COUNT", "Remark": "REMARK"},
    "dup_cust": {"Customer Name": "CUST_NM", "Customer Code": "CUST_CD", "Count": "COUNT", "Remark": "REMARK"},
    "prod_name": {"Product Name": "PROD_NM", "Product Code": "PROD_CODE", "Count": "COUNT", "Remark": "REMARK"},
    "prod_code": {"Product Code": "PROD_CODE", "Status": "STATUS", "Remark": "REMARK"},
}
for _category, _layout in _LAYOUTS.items():
    _shown = ", ".join(f'{column} AS "{label}"' for label, column in _layout.items())
    SQL[f"hygiene_export_{_category}"] = f"SELECT {_shown} FROM ({SQL[f'hygiene_{_category}']}) m"
SQL["report_workbooks"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS CATEGORY, concat_ws(' | ', {', '.join(layout.values())}) AS CELLS FROM ({SQL[f'hygiene_{c}']}) m"""
    for c, layout in _LAYOUTS.items())
SQL["audit_trail_aliased"] = "WITH " + _AUDIT + """
SELECT * REPLACE ('M' || CAST(CAST(VendorNo AS BIGINT) % 5 AS VARCHAR) AS Process,
  CASE WHEN CAST(VendorNo AS BIGINT) % 3 = 0 THEN 'Unspecified' ELSE 'Team' END AS Owner,
  CASE WHEN CAST(VendorNo AS BIGINT) % 2 = 0 THEN '' ELSE 'last' END AS Remarks) FROM audit"""
SQL["audit_trail_evolved"] = "WITH " + _AUDIT + """
SELECT Process AS process, Control AS control, Status AS status, Owner AS owner, Department AS department, Remarks AS remarks,
""" + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in (
    "vendor_no", "vendor_name", "field_changed", "field_description", "indicator", "old_value", "new_value", "changed_by", "risk",
    "year", "quantity", "month_name")) + " FROM audit"
SQL["audit_flagged"] = "WITH " + _AUDIT + """
SELECT lower(trim(Risk)) = 'high' AS HIGH_RISK, CASE WHEN Indicator IN ('Deleted', 'Inserted') THEN Indicator ELSE '' END AS INDICATOR_FLAG,
  COUNT(*) AS "ROWS" FROM audit GROUP BY ALL"""
SQL["observations_flagged"] = f"""
SELECT category, RiskType IN ('High', 'Critical') AS HIGH_RISK, COUNT(*) AS "ROWS" FROM ({SQL['observations_loaded']}) t GROUP BY ALL"""
SQL["remarks_list"] = f"SELECT issue_id, remark FROM ({SQL['remarks']}) t"
SQL["audit_trail_from_workbooks"] = "WITH " + _AUDIT + "\nSELECT * EXCLUDE (row_idx) FROM audit"
