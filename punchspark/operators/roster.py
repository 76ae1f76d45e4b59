"""Roster sync and user administration.

The reference walks the roster row by row (up to three SQL round trips each).
Here every sequential effect becomes an order over ``row_ord``: the last row of an
ID wins its values (``max_by``), the first row of a new ID or department fixes its
insertion order (``min``), and new identity values are dense positions in that
order (``dense_index``), computed without a single-partition window.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchspark import policy as P
from punchspark.functions.text import js_trim, null_text_to_empty, upper_trim
from punchspark.operators.common import broadcast_if_small, checkpointed
from punchspark.sources.aliases import cells_for, resolve


# ---------------------------------------------------------------------------
# Distributed dense numbering
# ---------------------------------------------------------------------------


def dense_index(df: DataFrame, order: Column | list[Column], out: str = "idx", partitions: int | None = None, dtype: str = "int") -> DataFrame:
    """1-based position of each row by ``order`` (unique; sort keys may be descending), without a global window.

    Rows are range-partitioned and sorted on ``order``; the partition id and the
    position inside the partition come from ``monotonically_increasing_id`` (upper
    and lower bits). Each row then adds the row count of all earlier partitions
    (a table with one row per partition, broadcast). The partitioned frame is
    checkpointed to the shared checkpoint folder so both passes see the same rows
    (and lineage is cut).
    """
    keys = order if isinstance(order, list) else [order]
    # Without an explicit count AQE may coalesce the ranges; merged partitions are
    # adjacent ranges, so partition order still follows ``order``.
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    staged = checkpointed(ranged.sortWithinPartitions(*keys).withColumn("__mono", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("__mono"), 33)
    counts = staged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    local = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        staged.withColumn("__pid", pid)
        .join(F.broadcast(offsets), "__pid")
        .withColumn(out, (F.col("__off") + local).cast(dtype))
        .drop("__pid", "__mono", "__off")
    )


def top_value(df: DataFrame, column: str) -> Column:
    """The current top identity value (0 for an empty table) as a scalar subquery:
    evaluated inside the consuming query, no driver-side action, no join."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint")).scalar()


# ---------------------------------------------------------------------------
# Roster rows
# ---------------------------------------------------------------------------


def roster_rows(upload: DataFrame) -> DataFrame:
    """(upload_id, row_ord, staff, first, last, dept_name, emp_type) for rows with an ID."""
    cells = cells_for(upload)
    staff = resolve(cells, P.ROSTER_ID_ALIASES).value
    dept = resolve(cells, P.DEPARTMENT_ALIASES).value
    etype = resolve(cells, P.EMPTYPE_ALIASES).value
    first = resolve(cells, P.ROSTER_FIRST_ALIASES)
    last = resolve(cells, P.ROSTER_LAST_ALIASES)
    unified = resolve(cells, P.UNIFIED_NAME_ALIASES)

    # R2: names follow which name headers the file has (explicit, unified, or neither)
    clean_first = js_trim(F.coalesce(first.value, F.lit("")))
    explicit_first = F.when((clean_first == "") | (F.upper(clean_first) == "NULL"), F.lit("")).otherwise(clean_first)
    explicit_last = null_text_to_empty(F.coalesce(last.value, F.lit("")))
    explicit = first.defined | last.defined
    first_name = F.when(explicit, explicit_first).when(unified.defined, F.lit("")).otherwise(F.lit(P.DEFAULT_FIRST_NAME))
    last_name = (
        F.when(explicit, explicit_last)
        .when(unified.defined, null_text_to_empty(F.coalesce(unified.value, F.lit(""))))
        .otherwise(F.lit(P.DEFAULT_LAST_NAME))
    )
    rows = upload.select(
        "upload_id",
        "row_ord",
        upper_trim(F.coalesce(staff, F.lit(""))).alias("staff"),
        first_name.alias("first"),
        last_name.alias("last"),
        js_trim(F.coalesce(dept, F.lit(P.DEFAULT_DEPARTMENT))).alias("dept_name"),
        js_trim(F.coalesce(etype, F.lit(""))).alias("emp_type"),
    )
    return rows.where(F.col("staff") != "")


# ---------------------------------------------------------------------------
# departments
# ---------------------------------------------------------------------------


def dept_key(c: Column) -> Column:
    return F.lower(js_trim(c))


def unknown_departments(departments: DataFrame, rows: DataFrame) -> DataFrame:
    """Department keys (lower/trim) of the rows that have no department: first spelling and place."""
    seen = rows.groupBy(dept_key(F.col("dept_name")).alias("dkey")).agg(
        F.min_by("dept_name", "row_ord").alias("DepartmentName"), F.min("row_ord").alias("first_ord")
    )
    known = departments.select(dept_key(F.col("DepartmentName")).alias("dkey"))
    return seen.join(broadcast_if_small(known), "dkey", "left_anti")


def provision_departments(departments: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all departments incl. new ones, new departments).

    Unknown department keys (lower/trim) get the next IDs in order of first
    appearance; the first spelling is stored.
    """
    new = unknown_departments(departments, rows)
    top = top_value(departments, "DepartmentID")
    numbered = dense_index(new, F.col("first_ord"), "rank")
    new_depts = numbered.select((top + F.col("rank")).cast("int").alias("DepartmentID"), "DepartmentName")
    return departments.select("DepartmentID", "DepartmentName").unionByName(new_depts), new_depts


def dept_lookup(all_departments: DataFrame) -> DataFrame:
    """dkey → DepartmentID; when two names share a key, the highest ID (the later load) wins."""
    return all_departments.groupBy(dept_key(F.col("DepartmentName")).alias("dkey")).agg(
        F.max("DepartmentID").alias("DepartmentID")
    )


# ---------------------------------------------------------------------------
# Users upsert and metrics
# ---------------------------------------------------------------------------


class RosterSync:
    """R4-R6 on resolved roster rows (ordered by ``row_ord``). Each result is planned when it is
    asked for, so the counters number nothing and the departments leave the users alone."""

    def __init__(self, users: DataFrame, departments: DataFrame, rows: DataFrame):
        self._users, self._departments, self._rows = users, departments, rows
        self._existing = users.withColumn("staff", upper_trim(F.col("EmployeeNo")))

    @cached_property
    def _provisioned(self) -> tuple[DataFrame, DataFrame]:
        return provision_departments(self._departments, self._rows)

    @property
    def departments(self) -> DataFrame:
        return self._provisioned[0]

    @property
    def new_departments(self) -> DataFrame:
        return self._provisioned[1]

    @cached_property
    def _per_staff(self) -> DataFrame:
        """One row per staff key: its last row's values, first place, number of rows, whether a user has it."""
        vals = F.struct("first", "last", dept_key(F.col("dept_name")).alias("dkey"), "emp_type")
        per_staff = self._rows.groupBy("staff").agg(
            F.max_by(vals, F.col("row_ord")).alias("v"),
            F.min("row_ord").alias("first_ord"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        keys = self._existing.select("staff").distinct().withColumn("exists", F.lit(True))
        return per_staff.join(broadcast_if_small(keys), "staff", "left")

    @cached_property
    def users(self) -> DataFrame:
        lookup = dept_lookup(self.departments).withColumnRenamed("DepartmentID", "dept")
        # departments are looked up per staff key, not per uploaded row
        staff = self._per_staff.withColumn("dkey", F.col("v.dkey")).join(broadcast_if_small(lookup), "dkey", "left")
        new = lambda value, old: F.when(F.col("v").isNotNull(), value).otherwise(F.col(old)).alias(old)
        known = staff.where(F.col("exists")).select("staff", "v", "dept")
        updated = self._existing.join(known, "staff", "left").select(
            "UserID",
            "EmployeeNo",
            new(F.col("v.first"), "FirstName"),
            new(F.col("v.last"), "LastName"),
            new(F.col("dept"), "DepartmentID"),
            "Role",
            new(F.col("v.emp_type"), "EmpType"),
            "IsActive",
        )
        fresh = dense_index(staff.where(F.col("exists").isNull()), F.col("first_ord"), "rank")
        inserted = fresh.select(
            (top_value(self._users, "UserID") + F.col("rank")).cast("int").alias("UserID"),
            F.col("staff").alias("EmployeeNo"),
            F.col("v.first").alias("FirstName"),
            F.col("v.last").alias("LastName"),
            F.col("dept").cast("int").alias("DepartmentID"),
            F.lit(P.DEFAULT_ROLE).alias("Role"),
            F.col("v.emp_type").alias("EmpType"),
            F.lit(True).alias("IsActive"),
        )
        return updated.unionByName(inserted)

    @cached_property
    def metrics(self) -> DataFrame:
        """One aggregate over staff rows and new-department rows together (no join)."""
        found = unknown_departments(self._departments, self._rows)
        parts = self._per_staff.select(
            F.col("n_rows"), F.coalesce(F.col("exists"), F.lit(False)).alias("exists"), F.lit(False).alias("is_dept")
        ).unionByName(found.select(F.lit(0).cast("bigint").alias("n_rows"), F.lit(False).alias("exists"), F.lit(True).alias("is_dept")))
        staff_row = ~F.col("is_dept")
        skipped = F.when(F.col("exists"), F.col("n_rows")).otherwise(F.col("n_rows") - 1)
        return parts.agg(
            F.coalesce(F.sum(F.when(staff_row, F.col("n_rows"))), F.lit(0)).cast("bigint").alias("importedRows"),
            F.coalesce(F.sum(F.when(staff_row, skipped)), F.lit(0)).cast("bigint").alias("skippedDuplicates"),
            F.count_if(staff_row & ~F.col("exists")).alias("autoProvisionedUsers"),
            F.count_if(F.col("is_dept")).alias("autoProvisionedDepartments"),
            F.lit(0).cast("bigint").alias("unauthorizedRecords"),
        )


def sync_roster(users: DataFrame, departments: DataFrame, upload: DataFrame) -> RosterSync:
    """Departments, users upsert, counters."""
    return sync_roster_rows(users, departments, roster_rows(upload))


def sync_roster_rows(users: DataFrame, departments: DataFrame, rows: DataFrame) -> RosterSync:
    """R4-R6 on resolved roster rows."""
    return RosterSync(users, departments, rows)


# ---------------------------------------------------------------------------
# Administration in batches (rows ordered by ``req_ord``)
# ---------------------------------------------------------------------------


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def create_users(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(req_ord, employeeNo, firstName, lastName, departmentId, role, password).

    All six fields required; an ID already present (or earlier in the batch) is
    rejected. Returns (users, rejects with a reason).
    """
    req = requests.withColumn("staff", upper_trim(F.col("employeeNo")))
    complete = F.lit(True)
    for c in ("employeeNo", "firstName", "lastName", "departmentId", "role", "password"):
        complete = complete & _truthy(F.col(c))
    req = req.withColumn("complete", complete)
    keys = users.select(upper_trim(F.col("EmployeeNo")).alias("staff")).distinct().withColumn("exists", F.lit(True))
    first_of = req.where("complete").groupBy("staff").agg(F.min("req_ord").alias("first_req"))
    req = req.join(broadcast_if_small(keys), "staff", "left").join(first_of, "staff", "left")
    reason = (
        F.when(~F.col("complete"), F.lit("All fields are required."))
        .when(F.col("exists") | (F.col("req_ord") != F.col("first_req")), F.lit("Employee Number already exists."))
    )
    req = req.withColumn("reason", reason)
    ok = req.where(F.col("reason").isNull())
    top = top_value(users, "UserID")
    new = (
        dense_index(ok, F.col("req_ord"), "rank")
        .select(
            (top + F.col("rank")).cast("int").alias("UserID"),
            F.col("staff").alias("EmployeeNo"),
            js_trim(F.col("firstName")).alias("FirstName"),
            js_trim(F.col("lastName")).alias("LastName"),
            F.regexp_extract(F.col("departmentId").cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int").alias("DepartmentID"),
            F.col("role").alias("Role"),
            F.lit(None).cast("string").alias("EmpType"),
            F.lit(True).alias("IsActive"),
        )
    )
    rejects = req.where(F.col("reason").isNotNull()).select("req_ord", "employeeNo", "reason")
    return users.select(*new.columns).unionByName(new), rejects


def update_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(req_ord, employeeNo, firstName, lastName, departmentId, role); all four
    fields required; later changes win; unknown IDs are no-ops."""
    complete = F.lit(True)
    for c in ("firstName", "lastName", "departmentId", "role"):
        complete = complete & _truthy(F.col(c))
    vals = F.struct(
        js_trim(F.col("firstName")).alias("f"),
        js_trim(F.col("lastName")).alias("l"),
        F.regexp_extract(F.col("departmentId").cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int").alias("d"),
        F.col("role").alias("r"),
    )
    last = (
        changes.where(complete)
        .groupBy(F.upper(F.col("employeeNo")).alias("k"))
        .agg(F.max_by(vals, F.col("req_ord")).alias("v"))
    )
    j = users.join(broadcast_if_small(last), F.upper(users["EmployeeNo"]) == last["k"], "left")
    hit = F.col("v").isNotNull()
    return j.select(
        "UserID",
        "EmployeeNo",
        F.when(hit, F.col("v.f")).otherwise(F.col("FirstName")).alias("FirstName"),
        F.when(hit, F.col("v.l")).otherwise(F.col("LastName")).alias("LastName"),
        F.when(hit, F.col("v.d")).otherwise(F.col("DepartmentID")).alias("DepartmentID"),
        F.when(hit, F.col("v.r")).otherwise(F.col("Role")).alias("Role"),
        "EmpType",
        "IsActive",
    )


def set_active(users: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(req_ord, employeeNo, isActive or null); null means deactivate; later wins."""
    last = changes.groupBy(F.upper(F.col("employeeNo")).alias("k")).agg(
        F.max_by(F.coalesce(F.col("isActive").cast("boolean"), F.lit(False)), F.col("req_ord")).alias("flag")
    )
    j = users.join(broadcast_if_small(last), F.upper(users["EmployeeNo"]) == last["k"], "left")
    return j.select(
        "UserID",
        "EmployeeNo",
        "FirstName",
        "LastName",
        "DepartmentID",
        "Role",
        "EmpType",
        F.when(F.col("k").isNotNull(), F.col("flag")).otherwise(F.col("IsActive")).alias("IsActive"),
    )


# ---------------------------------------------------------------------------
# Directory views
# ---------------------------------------------------------------------------

DIRECTORY_COLUMNS = ("EmployeeNo", "FirstName", "LastName", "DepartmentID", "DepartmentName", "EmpType", "Role", "IsActive")


def directory(users: DataFrame, departments: DataFrame, strict: bool = False) -> DataFrame:
    """R10 (left join) / R11 (inner join): users with their department name."""
    d = broadcast_if_small(departments.select("DepartmentID", "DepartmentName"))
    return users.join(d, "DepartmentID", "inner" if strict else "left").select(*DIRECTORY_COLUMNS)


def directory_filter(directory_df: DataFrame, status: str = "Active", query: str | None = None) -> DataFrame:
    """UI fills, then All/Active/Inactive and a case-insensitive search of ID, 'first last', department."""
    filled = directory_df.select(
        "EmployeeNo",
        F.coalesce(F.when(F.col("FirstName") != "", F.col("FirstName")), F.lit("")).alias("FirstName"),
        F.coalesce(F.when(F.col("LastName") != "", F.col("LastName")), F.lit("")).alias("LastName"),
        "DepartmentID",
        F.coalesce(F.when(F.col("DepartmentName") != "", F.col("DepartmentName")), F.lit(P.B_DEFAULT_DEPARTMENT)).alias("DepartmentName"),
        F.coalesce(F.when(F.col("EmpType") != "", F.col("EmpType")), F.lit(P.A_DEFAULT_EMPTYPE)).alias("EmpType"),
        F.coalesce(F.when(F.col("Role") != "", F.col("Role")), F.lit(P.DEFAULT_ROLE)).alias("Role"),
        F.coalesce(F.col("IsActive"), F.lit(False)).alias("IsActive"),
    )
    if status == "Active":
        filled = filled.where(F.col("IsActive"))
    elif status == "Inactive":
        filled = filled.where(~F.col("IsActive"))
    q = (query or "").lower().strip()
    if q:
        full = F.lower(F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")))
        filled = filled.where(
            F.lower(F.col("EmployeeNo").cast("string")).contains(q)
            | full.contains(q)
            | F.lower(F.col("DepartmentName")).contains(q)
        )
    return filled


def departments_list(departments: DataFrame) -> DataFrame:
    """ID and name ordered by name."""
    return departments.select("DepartmentID", "DepartmentName").orderBy("DepartmentName")
