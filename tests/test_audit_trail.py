"""Audit-trail rules: added columns, normalisation, counts by vendor, field and risk."""

import pytest

from ledgerlens.operators import audit_trail as A

# One change per tuple: vendor, field, its description, risk, fiscal year, month, quantity, owner.
CHANGES = [
    ("o'neil supplies", "Address", "Street", "Low", "2019-20", "June", "7", "Dana"),
    ("AXIS BANK", "Services", "Scope", "High", "2019-20", "June", "3", "Dana"),
    ("Axis Bank Services", "BANKL", "", "", "2020-21", "November", "7", "Omar"),
    ("qatar bank", "PAN Number", "Scope", "high ", "2020-21", "November", "9", "Omar"),
    ("", "Services", "Unspecified", "Low", "2021-22", "May", "3", "Lee"),
]


@pytest.fixture()
def trail(spark):
    names = ["VendorName", "FieldChanged", "FieldDescription", "Risk", "Year", "MonthName", "Quantity", "Owner"]
    rows = [dict(zip(names, c, strict=True), Status="Open" if i % 2 else "Closed") for i, c in enumerate(CHANGES)]
    return A.audit_trail_normalize(spark.createDataFrame(rows))


def test_table_of_an_older_layout_gains_its_missing_columns(spark):
    older = spark.createDataFrame([(1, "P")], "id int, process string")
    evolved = A.schema_evolve(older, ["process", "vendor_no", "year"])
    assert evolved.columns == ["id", "process", "vendor_no", "year"]
    assert evolved.first().asDict() == {"id": 1, "process": "P", "vendor_no": None, "year": None}
    assert A.schema_evolve(evolved, ["year"]).columns == evolved.columns


def test_vendor_names_are_written_one_way(trail):
    assert {r["VendorName"] for r in trail.collect()} == {"O'Neil Supplies", "Axis Bank", "Axis Bank Services", "Qatar Bank", "Unspecified"}


def test_named_vendors_are_counted_by_field(trail):
    found = {r["vendorName"]: r for r in A.audit_vendor_buckets(trail).collect()}
    assert set(found) == {"Axis", "Qatar"}  # neither HDFC, of which there is none, nor all the others
    assert (found["Axis"]["servicesCount"], found["Axis"]["banklCount"], found["Axis"]["grandTotal"]) == (1, 1, 2)
    assert found["Qatar"]["grandTotal"] == 1


def test_risk_is_counted_by_description_or_field(trail):
    risk = {r["fieldDescription"]: (r["highRiskCount"], r["lowRiskCount"]) for r in A.audit_field_risk(trail).collect()}
    assert risk["Scope"] == (2, 0)
    assert risk["Street"] == (0, 1)
    assert sum(map(sum, risk.values())) == len(CHANGES)


def test_filters_and_summaries_agree(trail):
    chosen = A.filter_audit_trail(trail, {"Year": "2020-21", "MonthName": ""})
    assert {r["vendorName"]: r["grandTotal"] for r in A.audit_vendor_summary(chosen).collect()} == \
        {"Axis Bank Services": 1, "Qatar Bank": 1}
    counts = A.audit_match_counts(trail, {"Quantity": "7"}).first()
    assert (counts["matching_rows"], counts["all_rows"]) == (2, 5)
    assert A.audit_total_rows(trail).first()["total_rows"] == 5
    by_status = {r["VALUE"]: r["ROWS"] for r in A.audit_counts(trail, "Status").collect()}
    assert by_status == {"Closed": 3, "Open": 2}


def test_facets_list_each_value_once(trail):
    facets = [(r["FACET"], r["VALUE"]) for r in A.audit_facets(trail).collect()]
    assert len(facets) == len(set(facets))
    assert {v for f, v in facets if f == "MonthName"} == {"June", "November", "May"}


def test_normalising_again_changes_nothing(trail):
    again = A.audit_trail_normalize(trail)
    assert sorted(map(tuple, trail.select(A.AUDIT_FIELDS).collect())) == sorted(map(tuple, again.select(A.AUDIT_FIELDS).collect()))


def test_a_blank_alias_hides_the_columns_after_it(spark):
    row = A.audit_trail_normalize(spark.createDataFrame([{"Module": "", "Vendor Name": "qatar bank", "Comments": "seen"}])).first()
    assert (row["Process"], row["Remarks"], row["VendorName"]) == ("Unspecified", "seen", "Qatar Bank")
