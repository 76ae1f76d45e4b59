from pyspark.sql import functions as F

from helpers import depts_df, rows_by, upload_df, users_df
from punchspark.operators import roster as R


def base(spark):
    users = users_df(spark, [(1, "ADMIN", "System", "Admin", 1, "Admin", None, True), (2, "EMP001", "Old", "Name", 1, "User", "Regular", False)])
    depts = depts_df(spark, [(1, "IT"), (2, "HR")])
    return users, depts


def test_unified_name_roster(spark):
    users, depts = base(spark)
    up = upload_df(spark, ["Staff No.", "Name", "Department", "Emp.Type"], [["emp009", " Jane Q Public ", "Finance", "Contract"]])
    sync = R.sync_roster(users, depts, up)
    u = rows_by(sync.users, "EmployeeNo")["EMP009"]
    assert (u["FirstName"], u["LastName"], u["Role"], u["IsActive"], u["UserID"], u["EmpType"]) == ("", "Jane Q Public", "User", True, 3, "Contract")
    m = sync.metrics.first()
    assert (m["importedRows"], m["autoProvisionedUsers"], m["skippedDuplicates"], m["autoProvisionedDepartments"]) == (1, 1, 0, 1)
    assert rows_by(sync.departments, "DepartmentName")["Finance"]["DepartmentID"] == 3


def test_explicit_names_with_null_text_and_update(spark):
    users, depts = base(spark)
    up = upload_df(
        spark,
        ["Staff No.", "First Name", "Last Name", "Department", "Emp.Type"],
        [["EMP001", "NULL", "Doe", "hr", "Perm"], ["EMP002", "Ann", "NULL", "", ""], ["EMP001", "Jon", "Doe", "it", "Perm"]],
    )
    sync = R.sync_roster(users, depts, up)
    u = rows_by(sync.users, "EmployeeNo")
    # later row of EMP001 wins; role/active kept
    assert (u["EMP001"]["FirstName"], u["EMP001"]["DepartmentID"], u["EMP001"]["IsActive"], u["EMP001"]["UserID"]) == ("Jon", 1, False, 2)
    assert (u["EMP002"]["FirstName"], u["EMP002"]["LastName"]) == ("Ann", "")
    # '' department cell is a department named '' (the reference only defaults when the cell is empty text)
    m = sync.metrics.first()
    assert (m["importedRows"], m["autoProvisionedUsers"], m["skippedDuplicates"]) == (3, 1, 2)


def test_blank_names_fall_to_new_employee(spark):
    users, depts = base(spark)
    # 'FirstName' matches the header 'First Name' (whitespace ignored), so blank cells give ''.
    up = upload_df(spark, ["Staff No.", "First Name", "Last Name"], [["E5", "", ""]])
    u = rows_by(R.sync_roster(users, depts, up).users, "EmployeeNo")["E5"]
    assert (u["FirstName"], u["LastName"]) == ("", "")
    # no name header at all → 'New' / 'Employee'; no department header → 'IT'
    up = upload_df(spark, ["Staff No.", "Emp.Type"], [["E6", "Perm"]])
    u = rows_by(R.sync_roster(users, depts, up).users, "EmployeeNo")["E6"]
    assert (u["FirstName"], u["LastName"], u["DepartmentID"]) == ("New", "Employee", 1)


def test_dense_index_is_global_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = R.dense_index(df, F.col("k"), "i", partitions=4).orderBy("k").collect()
    assert [r["i"] for r in got] == list(range(1, 1001))


def test_admin_batches(spark):
    users, depts = base(spark)
    req = spark.createDataFrame(
        [(1, " e10 ", " A ", "B", "2", "User", "pw"), (2, "E10", "C", "D", "1", "User", "pw"), (3, "E11", "", "D", "1", "User", "pw"), (4, "emp001", "X", "Y", "1", "User", "pw")],
        "req_ord long, employeeNo string, firstName string, lastName string, departmentId string, role string, password string",
    )
    new_users, rejects = R.create_users(users, req)
    u = rows_by(new_users, "EmployeeNo")
    assert (u["E10"]["FirstName"], u["E10"]["DepartmentID"], u["E10"]["UserID"]) == ("A", 2, 3)
    assert sorted(r["req_ord"] for r in rejects.collect()) == [2, 3, 4]
    upd = R.update_users(users, req.where("req_ord = 4").withColumn("employeeNo", F.lit("EMP001")))
    assert rows_by(upd, "EmployeeNo")["EMP001"]["FirstName"] == "X"
    act = R.set_active(users, spark.createDataFrame([(1, "emp001", None), (2, "ADMIN", False)], "req_ord long, employeeNo string, isActive boolean"))
    a = rows_by(act, "EmployeeNo")
    assert a["EMP001"]["IsActive"] is False and a["ADMIN"]["IsActive"] is False


def test_directory_views(spark):
    users, depts = base(spark)
    users = users.unionByName(users_df(spark, [(3, "E3", None, "Solo", 9, None, None, True)]))
    left = rows_by(R.directory(users, depts), "EmployeeNo")
    assert left["E3"]["DepartmentName"] is None
    assert "E3" not in rows_by(R.directory(users, depts, strict=True), "EmployeeNo")
    f = rows_by(R.directory_filter(R.directory(users, depts), "Active", "unassigned"), "EmployeeNo")
    assert list(f) == ["E3"] and f["E3"]["EmpType"] == "Regular"
    assert [r["DepartmentName"] for r in R.departments_list(depts).collect()] == ["HR", "IT"]
