"""Hot-key fixtures: one key holds about a third of all rows.

The operators must give the brute-force answer while AQE's skew-join
splitting is forced on (tiny thresholds), i.e. when the hot partition is
actually split across tasks.
"""

import datetime as dt
import random

import pytest

from ledgerlens.operators import controls as C
from ledgerlens.operators import hygiene as H
from ledgerlens.operators import recon as R
from ledgerlens.operators.remarks import remarks_merge

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _key(rng, i):
    return "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"


def test_remarks_hot_issue(skewed):
    rng = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        action = "delete" if rng.random() < 0.05 else "save"
        rows.append((f"i:{_key(rng, i)}", f"c{rng.randrange(5)}", f"e{i}", f"r{i}", action,
                     t0 + dt.timedelta(seconds=rng.randrange(100000)), i))
    schema = "issue_id string, category string, entity_key string, remark string, action string, ts timestamp, seq long"
    got = {r["issue_id"]: (r["category"], r["entity_key"], r["remark"])
           for r in remarks_merge(skewed.createDataFrame(rows, schema)).collect()}
    table = {}
    for issue, cat, ek, remark, action, ts, seq in sorted(rows, key=lambda r: (r[5], r[6])):
        if action == "delete":
            table.pop(issue, None)
        elif issue in table:
            table[issue] = (table[issue][0], table[issue][1], remark)
        else:
            table[issue] = (cat, ek, remark)
    assert got == table


def test_three_way_match_hot_invoice(skewed):
    rng = random.Random(3)
    po = [(f"PO{i}", _key(rng, i), "A", "c", float(i), "May", 2024, rng.randrange(10**6)) for i in range(3000)]
    grn = [(f"G{i}", _key(rng, i), "B", "c", float(i), rng.randrange(10**6)) for i in range(1500)]
    bank = [("SBI", _key(rng, i), "C", 30, float(i), rng.randrange(10**6)) for i in range(900)]
    po_df = skewed.createDataFrame(po, "PO_NO string, INVOICE_NO string, COMP_NM string, CUST_NM string, AMT double, "
                                       "MONTH string, YEAR int, ORD long")
    grn_df = skewed.createDataFrame(grn, "GRN_NO string, INVOICE_NO string, COMP_NM string, CUST_NM string, "
                                         "AMT double, ORD long")
    bank_df = skewed.createDataFrame(bank, "BANK string, INVOICE_NO string, COMP_NM string, PAYMENT_DAYS int, "
                                           "AMT double, ORD long")
    got = {r["INVOICE_NO"]: (r["PO_NO"], r["GRN_NO"], r["MATCH"])
           for r in R.three_way_match(po_df, grn_df, bank_df, limit=None).collect()}

    def first(rows, no_idx, ord_idx):
        out = {}
        for r in rows:
            k = r[1]
            if k not in out or (r[ord_idx], r[no_idx]) < out[k]:
                out[k] = (r[ord_idx], r[no_idx])
        return {k: v[1] for k, v in out.items()}

    p, g, b = first(po, 0, 7), first(grn, 0, 5), first(bank, 0, 5)
    want = {}
    for k in set(p) | set(g) | set(b):
        match = "✓ Match" if k in g and k in b else ("⚠ Partial" if k in g or k in b else "✗ Missing")
        want[k] = (p.get(k, "Missing"), g.get(k, "Missing"), match)
    assert got == want
    # anti joins with a hot key on both sides
    assert R.grn_without_invoice(grn_df, po_df, limit=None).count() == sum(1 for r in grn if r[1] not in p)


def test_hygiene_hot_product(skewed):
    rng = random.Random(5)
    rows = [(_key(rng, i), f"name{rng.randrange(3) if i % 3 == 0 else 0}", float(rng.choice([0, 5, 12])), "",
             "Cust", "S1") for i in range(3000)]
    df = skewed.createDataFrame(rows, "PROD_CODE string, PROD_NM string, GST_RATE double, TAX_DESC string, "
                                      "CUST_NM string, CUST_STATE string")
    got = {r["ENTITY_KEY"]: r["COUNT"] for r in H.multi_tax_filtered(df).collect()}
    rates, counts = {}, {}
    for code, _, rate, _, _, _ in rows:
        counts[code] = counts.get(code, 0) + 1
        if rate:
            rates.setdefault(code, set()).add(rate)
    want = {k: counts[k] for k, v in rates.items() if len(v) > 1}
    assert got == want
    codes = {r["ENTITY_KEY"]: r["STATUS"] for r in H.prod_code_filtered(df).collect()}
    assert codes.get("hot") == "Multiple products"


def test_shared_account_third_of_employees(skewed):
    rows = [(i, f"E{i}", "ACCT-HOT" if i % 3 == 0 else f"A{i // 2}") for i in range(3000)]
    emp = skewed.createDataFrame(rows, "emp_id long, name string, bank_acct string")
    got = C.hr_dup_bank(emp)
    hot = got.filter("BANK_ACCT = 'ACCT-HOT'")
    assert hot.count() == 1000
    assert {r["EMPLOYEES"] for r in hot.select("EMPLOYEES").distinct().collect()} == {1000}
    by_acct = {}
    for i, _, a in rows:
        by_acct.setdefault(a, set()).add(i)
    assert got.count() == sum(len(v) for v in by_acct.values() if len(v) > 1)
