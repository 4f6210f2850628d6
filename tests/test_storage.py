"""Published tables (K1, S4), tables kept by category (K5, K6), workbooks as a data source (S1, K8), S6, ranks and chunks (H3, H5)."""

import glob
import io
import os
import time
import zipfile
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import hygiene as H
from ledgerlens.operators import recon as R
from ledgerlens.operators.observations import ALL_FIELDS, observations_delete, observations_upsert
from ledgerlens.operators.ranks import ranked_in_groups
from ledgerlens.plans import inputs as I
from ledgerlens.plans.queries import QUERIES
from ledgerlens.session import shared_path
from ledgerlens.sinks import parts as PT
from ledgerlens.sinks import published as PB
from ledgerlens.sinks.tables import child_names, materialize
from ledgerlens.sources import tables as ST
from ledgerlens.sources import testdata as T
from ledgerlens.sources import workbook as W
from ledgerlens.sources import workbook_format as WF

SF = "/root/testdata/sf0.001"


# ---- ranks and chunks

def test_ranks_across_ranges(spark):
    rng = random.Random(3)
    pairs = {(rng.choice("aaaaaaab"), rng.randrange(10_000)) for _ in range(4000)} | {("only", 1)}
    got = ranked_in_groups(spark.createDataFrame(list(pairs), "k string, code int").repartition(7), ["k"], ["code"]).collect()
    want = {}
    for k in {k for k, _ in pairs}:
        want |= {(k, c): i for i, c in enumerate(sorted(c for kk, c in pairs if kk == k))}
    assert {(r.k, r.code): r.place for r in got} == want and len(got) == len(pairs)


def test_lists_in_chunks_hold_no_name_in_one_task(spark):
    rows = [("Hot", f"c{k:05d}") for k in range(3000)] * 2 + [("Two", "x"), ("Two", "y"), ("One", "z"), ("One", "z"), (None, "q"), ("", None)]
    df = spark.createDataFrame(rows, "PROD_NM string, PROD_CODE string").repartition(5)
    chunks = H.prod_name_chunks(df, size=100).orderBy("PROD_NM", "CHUNK").collect()
    hot = [r for r in chunks if r.PROD_NM == "Hot"]
    assert [r.CHUNK for r in hot] == list(range(30)) and {r.CODES for r in hot} == {3000} and {r.COUNT for r in hot} == {6000}
    assert ", ".join(r.PROD_CODE for r in hot) == ", ".join(f"c{k:05d}" for k in range(3000))
    # Joined in order, the chunks are the report's lists.
    joined = {}
    for r in chunks:
        joined[r.PROD_NM] = ", ".join(filter(None, [joined.get(r.PROD_NM), r.PROD_CODE]))
    assert joined == {r.PROD_NM: r.PROD_CODE for r in H.prod_name_filtered(df).collect()}
    # The name's pairs were ranked in several ranges, none with all of them.
    pairs = df.select(F.col("PROD_NM").alias("k"), F.col("PROD_CODE").alias("code")).filter("k = 'Hot'").distinct()
    per_task = pairs.repartitionByRange(4, "k", "code").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < 1500


# ---- publications

def _tables(spark):
    lines = I.enriched(spark, SF).persist()
    invoices = R.invoice_rollup(lines, line_col="_line", extra=["_ord", "_nationkey"])
    return PB.result_tables(lines, *T.recon_tables(invoices))


def test_published_tables_have_the_fixed_columns(spark):
    tables = _tables(spark)
    assert set(tables) == set(PB.ALL_TABLES) and len(tables) == 12
    for name, columns in PB.TABLE_COLUMNS.items():
        assert tables[name].columns == columns
    assert tables["purchases"].columns[:3] == ["invoice_no", "store_code", "store_name"] and len(tables["purchases"].columns) == 36
    row = tables["purchases"].first()
    assert len(row.bill_date_time) == 19 and len(row.business_day_date) == 10 and row.bill_date_time[:10] == row.business_day_date


def test_match_of_published_tables_needs_no_exchange(spark, tmp_dir):
    tables = _tables(spark)
    got = PB.publish(spark, {n: tables[n] for n in PB.BY_INVOICE}, f"{tmp_dir}/pub", [])
    sides = PB.with_order(got)
    for plan in (R.three_way_match(*sides, limit=None), R.grn_without_invoice(sides[1], sides[0], limit=None).hint("merge"),
                 R.open_po(sides[0], sides[1], limit=None)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            text = plan._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Exchange" not in text, text
    want = R.three_way_match(*PB.with_order(tables), limit=None).collect()
    assert sorted(map(tuple, R.three_way_match(*sides, limit=None).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_stored_tables_hold_until_an_input_changes(spark, tmp_dir):
    source, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    spark.range(5).write.parquet(source)
    made = []

    def compute():
        made.append(1)
        rows = spark.read.parquet(source)
        return {"purchases": rows, "po": rows.select(F.col("id").cast("string").alias("INVOICE_NO"), (F.col("id") * 2).alias("AMT"))}

    names = ["purchases", "po"]
    first = PB.stored_or_computed(spark, out, [source], names, compute, buckets=2)
    again = PB.stored_or_computed(spark, f"file://{out}", [source], names, compute, buckets=2)
    assert len(made) == 1 and again["po"].count() == first["po"].count() == 5
    spark.range(3).write.mode("append").parquet(source)
    assert PB.stored(spark, out, [source], names) is None
    assert PB.stored_or_computed(spark, out, [source], names, compute)["purchases"].count() == 8 and len(made) == 2
    assert PB.stored(spark, out, [source], ["grn"]) is None  # a table is missing
    os.makedirs(os.path.join(out, "v000009", "po"))  # a version without its manifest does not count
    assert PB.stored(spark, out, [source], names)["purchases"].count() == 8
    empty = os.path.join(tmp_dir, "empty")
    PB.publish(spark, {"purchases": spark.range(0)}, empty, [source])
    assert PB.stored(spark, empty, [source], ["purchases"]) is None


def _inputs(spark, folder):
    """V1's tables in small: keys that come twice, keys without a partner, nulls, unrounded money."""
    rng = random.Random(5)
    day = lambda: datetime(1995, 1, 1 + rng.randrange(28), 10, 30)
    lines = [(rng.choice([*range(40), 99, None]), rng.choice([*range(12), 77]), rng.choice([*range(6), None]), k % 5, rng.choice([1.0, 3.0, 7.0]),
              rng.choice([None, rng.random() * 1e5, 12345.67]), rng.choice([0.0, 0.07, 0.1, None]), rng.choice([0.0, 0.08, None])) for k in range(400)]
    rows = {
        "region": [(0, "ASIA"), (1, "EUROPE")], "nation": [(0, "INDIA", 0), (1, "FRANCE", 1), (2, " ", 1)],
        "supplier": [(k, "s", k % 4, 0.0) for k in range(6)] + [(2, "again", 0, 1.0)],
        "customer": [(k, "c", 0, 0.0, rng.choice(["BUILDING", "MACHINERY", None])) for k in range(5)],
        "part": [(k, rng.choice(["red pin", "bolt"]), f"Brand#{k % 3}", "LARGE", k % 7, 1.0) for k in range(12)] + [(3, "twice", "Brand#9", "SMALL", 4, 1.0)],
        "orders": [(k, k % 6, "O", 1.0, None if k == 7 else day(), "1-URGENT") for k in range(40)] + [(5, 1, "F", 2.0, day(), "5-LOW")],
        "lineitem": [(o, p, s, n, *rest, "N", "O", day()) for o, p, s, n, *rest in lines],
    }
    for name, made in rows.items():
        spark.createDataFrame(made, T.SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_lines_joined_in_parts_are_those_of_the_view(spark, tmp_dir):
    sf = _inputs(spark, tmp_dir)
    want, whole = _sorted(T.purchase_source(spark, sf)), T.purchase_lines(spark, sf)
    assert len(want) > 150 and _sorted(T.purchase_columns(whole)) == want
    parts = [T.purchase_lines(spark, sf, k, 3) for k in range(3)]
    assert sorted((r for p in parts for r in _sorted(T.purchase_columns(p))), key=str) == want
    keys = [{r.l_orderkey for r in p.collect()} for p in parts]
    assert all(keys) and sum(map(len, keys)) == len(set().union(*keys))


def test_tables_made_from_the_published_purchases(spark, tmp_dir):
    lines = I.enriched(spark, _inputs(spark, f"{tmp_dir}/in")).persist()
    again = PB.published_lines(materialize(PB.purchase_table(lines), "purchases"))
    assert _sorted(again) == _sorted(lines.select(*again.columns))
    want = PB.derived_tables(lines)
    assert set(want) == set(PB.ALL_TABLES) - {"purchases", "blocked_vendors", *PB.BY_INVOICE}
    for name, table in PB.derived_tables(again).items():
        assert _sorted(table) == _sorted(want[name]) and (name in ("prod_code_check", "dup_customers") or table.count())


def test_a_table_is_published_before_the_next_is_made(spark, tmp_dir):
    def tables(written):
        yield "purchases", spark.range(4)
        assert set(written) == {"purchases"} and os.path.exists(f"{tmp_dir}/v000001/purchases/_SUCCESS")
        yield "po", written["purchases"].select(F.col("id").cast("string").alias("INVOICE_NO"))

    got = PB.stored_or_computed(spark, tmp_dir, [], ["purchases", "po"], lambda: tables, buckets=2)
    assert set(got) == {"purchases", "po"} and sorted(r.INVOICE_NO for r in got["po"].collect()) == ["0", "1", "2", "3"]
    assert PB.stored(spark, tmp_dir, [], ["purchases", "po"])["po"].count() == 4


def test_publishing_leaves_no_shuffle_files(spark, tmp_dir):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir")
    shuffled = lambda: {f for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    rows = spark.range(1000).select((F.col("id") % 300).cast("string").alias("INVOICE_NO"))
    before, cleanup = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with PB.set_within(spark, {cleanup: "false"}):  # other tests may have set it
        PB.publish(spark, {"po": rows, "multi_tax": rows.groupBy("INVOICE_NO").count()}, tmp_dir, [], buckets=2)
        assert spark.conf.get(cleanup) == "false"  # as it was
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert shuffled() - before == set()


def test_tables_made_from_a_bucketed_one_need_no_shuffle(spark, tmp_dir):
    rows = spark.range(1000).select((F.col("id") % 300).cast("string").alias("INVOICE_NO"), (F.col("id") % 7).alias("n"))
    invoices = PB.bucketed(rows.groupBy("INVOICE_NO").agg(F.sum("n").alias("n")), f"{tmp_dir}/invoices", 3)
    po = invoices.filter("n > 5").select((F.col("n") * 2).alias("AMT"), "INVOICE_NO")
    with PB.set_within(spark, PB.WHILE_WRITING):
        plan = po.repartition(3, "INVOICE_NO")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
    got = PB.publish(spark, {"po": po}, f"{tmp_dir}/out", [], buckets=3)["po"]
    assert len(got.inputFiles()) == 3 and _sorted(got) == _sorted(po) and got.count() > 100
    known = PB._registered(f"{tmp_dir}/invoices")
    assert spark.catalog.tableExists(known)
    PB.drop_bucketed(spark, f"{tmp_dir}/invoices")
    assert not spark.catalog.tableExists(known) and not os.path.exists(f"{tmp_dir}/invoices")


def test_publishing_leaves_no_tables_between(spark, tmp_dir):
    tables = lambda: {n for n in child_names(spark, shared_path(spark, "")) if n.startswith(("lines-", "invoices-"))}
    sf, before = _inputs(spark, tmp_dir), tables()
    rows = {r.TABLE: r.ROWS for r in QUERIES["published_tables"](spark, sf).collect()}
    assert tables() == before
    assert set(rows) == set(PB.ALL_TABLES) and rows["purchases"] == rows["gst_check"] == I.enriched(spark, sf).count()


# ---- observations by category

def _observation(i, category, **more):
    return {**{f: "" for f in ALL_FIELDS}, "ObservationTitle": f"t{i}", "category": category, "id": i, "updated_at": "old", **more}


@pytest.fixture()
def kept(spark, tmp_dir):
    rows = [_observation(i, ["multi_tax", "dup_cust", "prod_gst"][i % 3]) for i in range(1, 31)]
    frame = spark.createDataFrame([[r[c] for c in [*ALL_FIELDS, "id", "updated_at"]] for r in rows],
                                  ", ".join(f"{f} string" for f in ALL_FIELDS) + ", id long, updated_at string")
    folder = os.path.join(tmp_dir, "obs")
    PT.create_parts(frame, folder)
    return frame, folder


def _sorted(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def _files(folder):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/**/*.parquet", recursive=True) if "/schema/" not in p}


def test_upsert_writes_touched_categories_only(spark, kept):
    frame, folder = kept
    before = _files(folder)
    # Row 3 stays in multi_tax, row 4 (dup_cust) moves to a new category, 99 is unknown, one row is new.
    changes = spark.createDataFrame(
        [(3, "multi_tax", "changed", 1), (4, "brand_new", "moved", 2), (99, "prod_gst", "nobody", 3), (None, "multi_tax", "added", 4)],
        "id long, category string, ObservationTitle string, seq int")
    touched = PT.upsert_parts(spark, folder, changes, stamped=F.lit("now"))
    assert touched == {"multi_tax", "dup_cust", "brand_new"}
    assert _sorted(PT.read_parts(spark, folder)) == _sorted(observations_upsert(frame, changes, stamped=F.lit("now")))
    assert {p: t for p, t in _files(folder).items() if p in before} == before
    new = [p for p in _files(folder) if p not in before]
    assert new and not any(PT._part("prod_gst") in p for p in new)
    listed = PT.read_parts(spark, folder, ["prod_gst"])
    assert {os.path.dirname(f).rsplit("/", 1)[-1] for f in listed.inputFiles()} == {f"part={PT._part('prod_gst')}"}


def test_delete_and_ids_are_never_used_again(spark, kept):
    frame, folder = kept
    ids = spark.createDataFrame([(30,), (2,), (77,)], "id int")
    assert PT.delete_parts(spark, folder, ids) == {"multi_tax", "prod_gst"}
    assert _sorted(PT.read_parts(spark, folder)) == _sorted(observations_delete(frame, ids))
    added = spark.createDataFrame([(None, "dup_cust", "later", 1)], "id long, category string, ObservationTitle string, seq int")
    PT.upsert_parts(spark, folder, added)
    assert PT.read_parts(spark, folder).filter("ObservationTitle = 'later'").first().id == 31
    assert PT.upsert_parts(spark, folder, added.filter("seq > 5")) == set()
    PT.delete_parts(spark, folder, spark.range(1, 100).select("id"))
    assert PT.read_parts(spark, folder).count() == 0
    PT.upsert_parts(spark, folder, added)
    assert [r.id for r in PT.read_parts(spark, folder).collect()] == [32]


def test_a_broken_commit_is_not_read(spark, kept):
    frame, folder = kept
    os.makedirs(os.path.join(folder, "commits", f"{2:012d}"))  # a writer died here
    assert PT.read_parts(spark, folder).count() == 30


# ---- workbooks

def test_workbooks_written_and_read(spark, tmp_dir):
    rows = [("A & <B>", 3, 2.5, None), (' "q" ', None, -1.0, "tab\tline\nend"), ("漢字", 10**12, 0.1, "")]
    df = spark.createDataFrame(rows, "`Product Name` string, Count long, `GST Rate (%)` double, Remark string").repartition(2)
    folder = os.path.join(tmp_dir, "books")
    WF.write_workbooks(df, folder)
    names = sorted(os.listdir(folder))
    assert names and all(n.startswith("part-") and n.endswith(".xlsx") for n in names)
    read = WF.read_workbooks(spark, f"file://{folder}")
    assert read.columns == ["path", "row_idx", *df.columns]
    got = sorted(tuple(r) for r in read.select(*df.columns).collect())
    want = sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    assert got == want
    # The same as the job that reads workbooks through Spark's own file systems.
    other = W.select_columns(W.workbook_table(spark, folder), df.columns)
    assert sorted(tuple(r)[2:] for r in other.collect()) == want and other.count() == read.count()
    assert WF.read_workbooks(spark, folder, ["Count", "Missing"]).select("Missing").distinct().collect()[0][0] is None
    content = WF._open(folder, os.path.join(folder, names[0]))
    assert content.first_sheet() == "xl/worksheets/sheet1.xml"
    WF.write_workbooks(df.limit(1), folder)  # in place of the old ones
    assert WF.read_workbooks(spark, folder).count() == 1


def test_no_workbook_without_rows(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "none")
    WF.write_workbooks(spark.createDataFrame([], "a string"), folder)
    assert glob.glob(f"{folder}/*") == []
    assert WF.read_workbooks(spark, folder, ["a"]).count() == 0


def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "books")
    WF.write_workbooks(spark.range(3), folder)
    bad = spark.range(10).repartition(2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("id"))
    with pytest.raises(Exception, match="stop"):
        WF.write_workbooks(bad, folder)
    assert WF.read_workbooks(spark, folder).count() == 3 and not glob.glob(f"{folder}/_staging*")


def test_sheets_are_cut_at_their_most_rows(monkeypatch):
    monkeypatch.setattr(WF, "SHEET_ROWS", 3)
    rows = iter([(k,) for k in range(4)])
    first = list(W.Workbook(WF.workbook_bytes(["n"], rows)).rows())
    assert first == [["n"], ["0"], ["1"], ["2"]] and list(rows) == [(3,)]


# ---- S6

def test_audit_trail_from_workbooks_else_table(spark, tmp_dir):
    books, table = os.path.join(tmp_dir, "books"), os.path.join(tmp_dir, "table")
    assert ST.audit_trail_current(spark, books, table) is None
    rows = spark.createDataFrame([("axis bank", "High", "x"), ("o'neil", "", "y")], "`Vendor Name` string, Risk string, `Changed By` string").coalesce(1)
    WF.write_workbooks(rows, books)
    got = ST.audit_trail_current(spark, books, table).orderBy("id").collect()
    assert [(r.id, r.VendorName, r.Risk, r.Owner, r.source_file) for r in got] == [
        (1, "Axis Bank", "High", "x", "books"), (2, "O'Neil", "Unspecified", "y", "books")]
    stored = ST.audit_trail_current(spark, os.path.join(tmp_dir, "nothing"), table)
    assert _sorted(stored) == sorted(map(tuple, [[r[c] for c in sorted(stored.columns)] for r in got]), key=str)
    WF.write_workbooks(rows.limit(0), os.path.join(tmp_dir, "hollow"))
    assert ST.audit_trail_current(spark, os.path.join(tmp_dir, "hollow"), table).count() == 2


def test_workbooks_of_other_headers_are_parsed_once_for_all_rows(spark, tmp_dir, monkeypatch):
    books = os.path.join(tmp_dir, "books")
    os.makedirs(books)
    rows = {"a": (["Risk", "path", "row_idx", " Risk "], [("High", "p", "1", "Low"), ("High",)]), "b": (["Notes", "Risk"], [("n", "High")]),
            "c": (["Unused"], [])}
    for name, (head, cells) in rows.items():
        with open(os.path.join(books, f"{name}.xlsx"), "wb") as out:
            out.write(WF.workbook_bytes(head, iter(cells)))
    heads = W.workbook_headers(spark, books).orderBy("path").collect()
    assert [r.names for r in heads] == [["Risk", "path", "row_idx"], ["Notes", "Risk"]]
    plans, ids = [], ST.dense_ids

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return ids(df, *rest)

    monkeypatch.setattr(ST, "dense_ids", watched)
    got = ST.audit_trail_current(spark, books, os.path.join(tmp_dir, "table")).orderBy("id").collect()
    assert [(r.id, r.row_idx, r.Risk, r.Remarks) for r in got] == [(1, "1", "Low", ""), (2, "", "Unspecified", ""), (3, None, "High", "n")]
    # The ids read their input twice: a written table, not the workbooks.
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_headers_need_only_the_beginning_of_a_sheet(spark, tmp_dir):
    rows = (f"<row><c><v>{k}</v></c></row>" for k in range(100_000))
    sheet = f'<worksheet xmlns="{W.MAIN[1:-1]}"><sheetData><row><c t="inlineStr"><is><t>n</t></is></c></row>{"".join(rows)}<broken'
    with zipfile.ZipFile(os.path.join(tmp_dir, "a.xlsx"), "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [r.names for r in W.workbook_headers(spark, tmp_dir).collect()] == [["n"]]


def test_cells_of_several_runs_and_characters_that_are_escaped():
    sheet = (f'<worksheet xmlns="{W.MAIN[1:-1]}"><sheetData><row><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c><x/>'
             '<c r="D1"><v>1</v></c><c t="inlineStr"><is><t/></is></c><c t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>')
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", sheet)
    assert list(W.Workbook(content.getvalue()).rows()) == [["ab", "", "", "1", "", "z"]]
    assert list(W.Workbook(WF.workbook_bytes(["a\x01\tb\x1f\n"], iter([]))).rows()) == [["a_x0001_\tb_x001F_\n"]]


def test_written_tables_are_compressed_well(spark, tmp_dir):
    PB.publish(spark, {"po": spark.createDataFrame([("I1",)], "INVOICE_NO string"), "multi_tax": spark.range(3)}, tmp_dir, [], buckets=2)
    files = glob.glob(f"{tmp_dir}/v000001/*/*.parquet")
    assert files and all(".zstd" in f for f in files)
    assert all(".zstd" in f for f in materialize(spark.range(3), "small").inputFiles())
