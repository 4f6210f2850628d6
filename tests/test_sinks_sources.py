"""Sinks (K1-K3, K8, snapshot swap) and sources (S1 workbook, S3 text scan)."""

import io
import os
import zipfile

from ledgerlens.sinks import tables as S
from ledgerlens.sources import tables as ST
from ledgerlens.sources import workbook as W


def test_dynamic_category_overwrite(spark, tmp_dir):
    path = os.path.join(tmp_dir, "obs")
    first = spark.createDataFrame([("a", "multi_tax"), ("b", "dup_cust")], "title string, category string")
    S.observations_write(first, path)
    second = spark.createDataFrame([("c", "multi_tax")], "title string, category string")
    S.observations_write(second, path)
    got = sorted((r["title"], r["category"]) for r in spark.read.parquet(path).collect())
    assert got == [("b", "dup_cust"), ("c", "multi_tax")]
    S.observations_write(second, path, mode="append")
    assert spark.read.parquet(path).count() == 3


def test_snapshot_pointer_and_publish(spark, tmp_dir):
    t = os.path.join(tmp_dir, "tbl")
    S.write_snapshot(spark.range(3), t)
    S.write_snapshot(spark.range(5), t)
    assert S.current_snapshot(spark, t).count() == 5
    out = os.path.join(tmp_dir, "pub")
    S.publish_tables({"x": spark.range(2), "y": spark.range(4)}, out)
    stored = S.stored_tables(spark, out, ["x", "y"])
    assert stored["y"].count() == 4
    assert S.stored_tables(spark, out, ["x", "z"]) is None
    S.publish_tables({"purchases": spark.range(0)}, f"file://{out}")
    assert S.stored_tables(spark, f"file://{out}", ["x", "purchases"]) is None


def test_an_unfinished_version_is_not_read(spark, tmp_dir):
    t = f"file://{tmp_dir}/tbl"
    assert S.current_snapshot(spark, t) is None
    S.write_snapshot(spark.range(3), t, tag=4)
    os.makedirs(os.path.join(tmp_dir, "tbl", "v000000000002-t5"))  # a write that did not commit
    assert S.current_snapshot(spark, t).count() == 3 and S.current_tag(spark, t) == 4
    S.write_snapshot(spark.range(6), t, tag=5)
    assert S.current_snapshot(spark, t).count() == 6 and S.current_tag(spark, t) == 5


def test_export_csv(spark, tmp_dir):
    from ledgerlens.operators.hygiene import export_frame

    issues = spark.createDataFrame([("P1", None, "r")], "PROD_CODE string, STATUS string, REMARK string")
    path = S.export_csv(export_frame(issues, "prod_code"), os.path.join(tmp_dir, "exp"))
    df = spark.read.option("header", True).csv(path)
    assert df.columns == ["Product Code", "Status", "Remark"]
    assert df.first()["Status"] == "Not in Master"
    assert S.export_csv(issues.limit(0), os.path.join(tmp_dir, "none")) is None


def _xlsx(rows_xml: str, shared: list[str]) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{sst}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows_xml}</sheetData></worksheet>")
    return buf.getvalue()


def test_workbook_ingest(spark, tmp_dir):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t>INV-1</t></is></c><c r="C2"><v>12.5</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>3</v></c></row>'
    )
    data = _xlsx(rows, ["Bill No", "Store Name", "Net Sale", "INV-2"])
    folder = os.path.join(tmp_dir, "wb")
    os.makedirs(folder)
    for name in ("a.xlsx", "b.xlsx"):
        with open(os.path.join(folder, name), "wb") as fh:
            fh.write(data)
    raw = W.workbook_rows(spark, folder)
    assert raw.count() == 6
    t = W.select_columns(W.workbook_table(spark, folder, lower_headers=True), ["bill no", "net sale", "missing"])
    got = sorted((r["bill no"], r["net sale"], r["missing"]) for r in t.collect())
    assert got == [("INV-1", "12.5", None), ("INV-1", "12.5", None), ("INV-2", "", None), ("INV-2", "", None)]


def test_workbook_headers_blank_repeated_and_padded(spark, tmp_dir):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>8</v></c><c r="C2"><v>9</v></c><c r="AA2"><v>5</v></c></row>'
        '<row r="3"><c r="C3"><v>1</v></c><c r="D3" t="b"><v>0</v></c></row>'
    )
    with open(os.path.join(tmp_dir, "c.xlsx"), "wb") as fh:
        fh.write(_xlsx(rows, ["Bill No\u00a0", " Amount"]))
    t = W.workbook_table(spark, tmp_dir)
    assert t.select("values").orderBy("row_idx").collect()[0][0] == {"Bill No": "7", "Amount": ""}
    got = [tuple(r)[2:] for r in W.select_columns(t, ["Bill No", "Amount"]).orderBy("row_idx").collect()]
    assert got == [("7", ""), ("", "0")]


def test_text_scan(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t.csv")
    with open(p, "w") as fh:
        fh.write("a,b\n1,NULL\n,x\n")
    got = [tuple(r) for r in ST.text_scan(spark, p).collect()]
    assert got == [("1", None), (None, "x")]


def test_audit_trail_replace_and_scan(spark, tmp_dir):
    from ledgerlens.operators.audit_trail import audit_trail_normalize

    raw = spark.createDataFrame([{"Vendor Name": "axis bank", "Risk": "High", "row_idx": 2},
                                 {"Vendor Name": None, "Risk": "", "row_idx": 1}])
    t = os.path.join(tmp_dir, "audit")
    S.audit_trail_replace(audit_trail_normalize(raw), "book.xlsx", t)
    stored = S.current_snapshot(spark, t)
    assert {r["source_file"] for r in stored.collect()} == {"book.xlsx"}
    rows = ST.audit_trail_scan(stored.drop("created_at")).collect()
    assert [r["row_idx"] for r in rows] == [1, 2]
    assert rows[0]["VendorName"] == "Unspecified" and rows[1]["VendorName"] == "Axis Bank"
