"""HR / payroll and IT access-control exception checks.

Every check is an aggregation per key (map-side combined) plus, where the
exception is listed per employee, an equi-join back to the rows.  Names
sharing an id are *not* collected into one list: an id shared by a third
of all employees would make one unbounded row.  Instead each exception row
is (id, employee) with the number of employees sharing the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statutory id columns and their display names.
ID_COLUMNS = [("pan", "PAN"), ("aadhaar", "Aadhaar"), ("bank_acct", "Bank Account")]
# Master-data columns whose absence is an exception.
MASTER_COLUMNS = [("department", "Department"), ("location", "Location"), ("grade", "Grade")]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def _shared(emp: DataFrame, value_col: str, particulars: str | None = None) -> DataFrame:
    """(value, employee) rows for values used by more than one employee."""
    v = F.col(value_col)
    rows = emp.filter(~_blank(v)).select(v.alias("VALUE"), "emp_id", "name")
    shared = (
        rows.groupBy("VALUE")
        .agg(F.count_distinct("emp_id").alias("EMPLOYEES"))
        .filter(F.col("EMPLOYEES") > 1)
    )
    out = rows.join(shared, "VALUE")
    if particulars:
        out = out.withColumn("PARTICULARS", F.lit(particulars))
    return out


def hr_dup_bank(emp: DataFrame) -> DataFrame:
    """Bank accounts used by more than one employee."""
    return _shared(emp, "bank_acct").withColumnRenamed("VALUE", "BANK_ACCT")


def hr_dup_statutory_ids(emp: DataFrame) -> DataFrame:
    """PAN / Aadhaar / bank account shared by >1 employee, per (particulars, value).

    One ``unpivot`` then a single aggregation keyed by (particulars, value).
    """
    long = emp.unpivot(
        ["emp_id", "name"], [c for c, _ in ID_COLUMNS], "id_col", "VALUE"
    ).filter(~_blank(F.col("VALUE")))
    names = F.create_map(*[x for c, label in ID_COLUMNS for x in (F.lit(c), F.lit(label))])
    long = long.withColumn("PARTICULARS", names[F.col("id_col")]).drop("id_col")
    shared = (
        long.groupBy("PARTICULARS", "VALUE")
        .agg(F.count_distinct("emp_id").alias("EMPLOYEES"))
        .filter(F.col("EMPLOYEES") > 1)
    )
    return long.join(shared, ["PARTICULARS", "VALUE"])


def hr_missing_ids(emp: DataFrame) -> DataFrame:
    """One row per (employee, missing PAN / Aadhaar / bank account)."""
    return _missing(emp, ID_COLUMNS)


def hr_missing_master(emp: DataFrame) -> DataFrame:
    """C4: one row per (employee, missing department / location / grade)."""
    return _missing(emp, MASTER_COLUMNS)


def _missing(emp: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    flags = F.array(*[F.when(_blank(F.col(c)), F.lit(label)) for c, label in columns])
    return (
        emp.select("emp_id", "name", F.explode(F.array_compact(flags)).alias("MISSING"))
    )


def hr_same_pan(emp: DataFrame) -> DataFrame:
    """PAN shared by more than one employee."""
    return _shared(emp, "pan").withColumnRenamed("VALUE", "PAN")


def itc_access_after_lwd(events: DataFrame, exits: DataFrame, min_days: int = 1) -> DataFrame:
    """Leavers whose last access is ``min_days``+ days after their last working day."""
    last = events.filter(F.col("kind") == "login").groupBy("user_id").agg(F.max("ts").alias("last_access"))
    j = exits.join(last, "user_id")
    days = F.datediff(F.to_date("last_access"), F.col("last_working_day"))
    return j.select("user_id", "last_working_day", F.to_date("last_access").alias("last_access_date"),
                    days.alias("DAYS_AFTER_LWD")).filter(F.col("DAYS_AFTER_LWD") >= min_days)


def _days_since_last(events: DataFrame, kind: str, as_of: str, min_days: int, name: str) -> DataFrame:
    last = events.filter(F.col("kind") == kind).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date("last_ts"))
    return last.select("user_id", F.to_date("last_ts").alias("last_date"), days.alias(name)).filter(
        F.col(name) >= min_days
    )


def itc_inactive(events: DataFrame, as_of: str, min_days: int = 91) -> DataFrame:
    """Users whose last login is ``min_days``+ days before ``as_of``."""
    return _days_since_last(events, "login", as_of, min_days, "DAYS_NOT_LOGGED_IN")


def itc_password_stale(events: DataFrame, as_of: str, min_days: int = 91) -> DataFrame:
    """Users whose last password change is ``min_days``+ days before ``as_of``."""
    return _days_since_last(events, "password_change", as_of, min_days, "DAYS_SINCE_PWD_CHANGE")


def itc_after_hours(events: DataFrame, start_hour: int = 9, end_hour: int = 18, min_count: int = 1) -> DataFrame:
    """Logins outside business hours, count ≥ ``min_count``."""
    h = F.hour("ts")
    hits = events.filter((F.col("kind") == "login") & ((h < start_hour) | (h >= end_hour)))
    return hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("AFTER_HOURS_LOGINS")).filter(
        F.col("AFTER_HOURS_LOGINS") >= min_count
    )


def itc_failed_logins(events: DataFrame, min_count: int = 5) -> DataFrame:
    """Users with ``min_count``+ failed logins."""
    failed = F.col("kind") == "failed_login"
    # Filter first: the predicate reaches the scan and only failures shuffle.
    return events.filter(failed).groupBy("user_id").agg(F.count(F.lit(1)).alias("FAILED_LOGINS")).filter(
        F.col("FAILED_LOGINS") >= min_count
    )


def itc_above_limit(events: DataFrame, limits: DataFrame, min_count: int = 3) -> DataFrame:
    """C11: approvers with ``min_count``+ approvals above their authorised limit.

    Approvals above the limit are kept right after the join on user id (the
    limits table is sized at runtime by AQE), then counted per user.
    """
    approvals = events.filter(F.col("kind") == "approval").join(limits, "user_id")
    above = approvals.filter(F.col("value") > F.col("approval_limit"))
    return above.groupBy("user_id").agg(F.count(F.lit(1)).alias("ABOVE_LIMIT")).filter(
        F.col("ABOVE_LIMIT") >= min_count
    )
