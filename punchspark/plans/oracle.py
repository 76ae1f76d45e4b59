"""DuckDB SQL twins of the registered queries (the correctness oracle).

Tables available as views: events customer nation part supplier ...
Hours are integer half-up hundredths over microseconds, exactly as in Spark.
"""

from __future__ import annotations

from punchspark.plans import queries as Q

JS_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def js_trim(x: str) -> str:
    return JS_TRIM.format(x=x)


def fixed2(c: str) -> str:
    return f"concat(CAST({c} // 100 AS VARCHAR), '.', lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def js_number(c: str) -> str:
    return (
        f"CASE WHEN {c} % 100 = 0 THEN CAST({c} // 100 AS VARCHAR) "
        f"WHEN {c} % 10 = 0 THEN concat(CAST({c} // 100 AS VARCHAR), '.', CAST(({c} % 100) // 10 AS VARCHAR)) "
        f"ELSE {fixed2(c)} END"
    )


CENTS = "((date_diff('microsecond', fi, lo) * 100 + 1800000000) // 3600000000)"

USERS = """
SELECT CAST(c_custkey + 1 AS INTEGER) AS UserID, CAST(c_custkey AS VARCHAR) AS EmployeeNo, '' AS FirstName, c_name AS LastName,
       c_nationkey AS DepartmentID, 'User' AS Role, c_mktsegment AS EmpType, c_acctbal >= 0 AS IsActive
FROM customer"""
DEPTS = "SELECT n_nationkey AS DepartmentID, n_name AS DepartmentName FROM nation"
PUNCHES = """
SELECT event_id AS LogID, CAST(user_id AS VARCHAR) AS EmployeeNo, ts AS PunchDateTime, event_type AS DeviceName,
       props AS AreaName, CAST(NULL AS VARCHAR) AS Status
FROM events"""


ROUGH_PUNCHES = """
SELECT event_id AS LogID,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '  ' WHEN event_id % 23 = 0 THEN 'q"' || CAST(user_id AS VARCHAR)
            WHEN event_id % 29 = 0 THEN ' ' || CAST(user_id AS VARCHAR) || ' ' ELSE CAST(user_id AS VARCHAR) END AS EmployeeNo,
       date_trunc('hour', ts) AS PunchDateTime, event_type AS DeviceName, props AS AreaName,
       CASE WHEN event_type = 'error' THEN 'Unauthorized Entry' END AS Status
FROM events"""


def records_a(where_punch: str = "TRUE", where_user: str = "TRUE", where_status: str = "TRUE") -> str:
    return f"""
WITH users AS ({USERS}), depts AS ({DEPTS}), punches AS ({PUNCHES}),
days AS (
  SELECT EmployeeNo, CAST(PunchDateTime AS DATE) AS d, min(PunchDateTime) AS fi, max(PunchDateTime) AS lo
  FROM punches WHERE {where_punch} GROUP BY 1, 2
),
j AS (
  SELECT days.*, u.FirstName, u.LastName, u.EmpType, dp.DepartmentName AS Department,
         date_diff('microsecond', fi, lo) AS us,
         hour(fi) * 60 + minute(fi) AS im, hour(lo) * 60 + minute(lo) AS om,
         {CENTS} AS cents
  FROM days JOIN users u ON u.EmployeeNo = days.EmployeeNo
  JOIN depts dp ON dp.DepartmentID = u.DepartmentID
  WHERE {where_user}
),
rec AS (
  SELECT EmployeeNo AS EmployeeID,
    concat(coalesce(FirstName, ''), ' ', coalesce(LastName, '')) AS Name,
    Department,
    CASE WHEN coalesce(EmpType, '') <> '' THEN EmpType ELSE 'Regular' END AS EmpType,
    strftime(d, '%Y-%m-%d') AS Date,
    dayname(d) AS Weekday,
    strftime(fi, '%H:%M:%S') AS FirstIn,
    CASE WHEN us = 0 THEN 'Missing Checkout' ELSE strftime(lo, '%H:%M:%S') END AS LastOut,
    CASE WHEN us = 0 THEN '-' ELSE {fixed2('cents')} END AS TotalHours,
    CASE WHEN us = 0 THEN 'Incomplete Record'
         WHEN om < 1080 AND im > 550 THEN 'LATE_ENTRY_AND_EARLY_EXIT'
         WHEN om < 1080 THEN 'EARLY_DEPARTURE'
         WHEN im > 550 THEN 'LATE_ENTRY_AND_LATE_EXIT'
         WHEN us > 32400000000 THEN 'OVERTIME'
         ELSE 'ONTIME' END AS Status,
    CASE WHEN us = 0 THEN NULL ELSE cents END AS hours_cents,
    CASE WHEN us = 0 THEN NULL ELSE cents / 100.0 END AS hours
  FROM j
)
SELECT * FROM rec WHERE {where_status}"""


A_COLS = "EmployeeID, Name, Department, EmpType, Date, Weekday, FirstIn, LastOut, TotalHours, Status, hours"


def _records_filtered() -> str:
    wp = f"CAST(PunchDateTime AS DATE) BETWEEN DATE '{Q.FILTER_START}' AND DATE '{Q.FILTER_END}'"
    pat = f"'%{Q.FILTER_EMPLOYEE}%'"
    wu = (
        f"u.DepartmentID = {Q.FILTER_DEPARTMENT_ID} AND (u.EmployeeNo ILIKE {pat} OR u.FirstName ILIKE {pat} "
        f"OR u.LastName ILIKE {pat})"
    )
    return records_a(wp, wu)


def records_b(punches: str = PUNCHES, where: str = "TRUE") -> str:
    return f"""
WITH users AS ({USERS}), depts AS ({DEPTS}), punches AS (SELECT * FROM ({punches}) WHERE {where}),
g AS (
  SELECT CASE WHEN coalesce(EmployeeNo, '') = '' THEN 'UNKNOWN' ELSE {js_trim('EmployeeNo')} END AS EmployeeID,
         CAST(PunchDateTime AS DATE) AS day,
         min(PunchDateTime) AS fi, max(PunchDateTime) AS lo, count(*) AS punch_count,
         first(EmployeeNo ORDER BY PunchDateTime, LogID) AS raw_id,
         first(Status ORDER BY PunchDateTime, LogID) AS LogStatus,
         string_agg(strftime(PunchDateTime, '%-I:%M %p'), ', ' ORDER BY PunchDateTime) AS Punches
  FROM punches GROUP BY 1, 2
),
j AS (
  SELECT g.*, u.FirstName, u.LastName, u.EmpType, dp.DepartmentName AS DeptName,
         fi = lo AS single, hour(fi) < 13 AS morning,
         coalesce(LogStatus = 'Unauthorized Entry', FALSE) AS unauth,
         greatest({CENTS}, 0) AS cents,
         hour(fi) * 60 + minute(fi) AS im, hour(lo) * 60 + minute(lo) AS om
  FROM g LEFT JOIN users u ON u.EmployeeNo = g.raw_id
  LEFT JOIN depts dp ON dp.DepartmentID = u.DepartmentID
),
k AS (
  SELECT *,
    CASE WHEN FirstName IS NULL OR upper({js_trim('FirstName')}) = 'NULL' THEN '' ELSE {js_trim('FirstName')} END AS fname,
    CASE WHEN LastName IS NULL OR upper({js_trim('LastName')}) = 'NULL' THEN '' ELSE {js_trim('LastName')} END AS lname,
    CASE WHEN NOT single OR morning THEN fi END AS in_ts,
    CASE WHEN NOT single THEN lo WHEN NOT morning THEN fi END AS out_ts
  FROM j
)
SELECT EmployeeID, fname AS FirstName, lname AS LastName,
  CASE WHEN {js_trim("concat(fname, ' ', lname)")} <> '' THEN {js_trim("concat(fname, ' ', lname)")}
       WHEN unauth THEN 'Unauthorized Entry' ELSE 'Unknown Employee' END AS Name,
  CASE WHEN coalesce(DeptName, '') <> '' THEN {js_trim('DeptName')} ELSE 'Unassigned' END AS Department,
  CASE WHEN coalesce(EmpType, '') <> '' THEN {js_trim('EmpType')} ELSE 'N/A' END AS EmpType,
  strftime(day, '%d-%m-%Y') AS Date, strftime(day, '%Y-%m-%d') AS rawDate, dayname(day) AS Weekday,
  strftime(in_ts, '%-I:%M %p') AS FirstIn, strftime(out_ts, '%-I:%M %p') AS LastOut,
  CASE WHEN single AND morning THEN 'Not Checked Out' WHEN single THEN 'Not Checked In' ELSE {js_number('cents')} END AS TotalHours,
  CASE WHEN unauth THEN 'Unauthorized Entry'
       WHEN single AND morning THEN 'Early Departure'
       WHEN single THEN 'Late Arrival'
       WHEN cents > 900 THEN 'Overtime'
       WHEN im > 540 AND om < 1080 THEN 'Late & Early'
       WHEN im > 540 THEN 'Late Arrival'
       WHEN om < 1080 THEN 'Early Departure'
       ELSE 'Compliant' END AS Status,
  hour(in_ts) * 60 + minute(in_ts) AS rawFirstInMins,
  hour(out_ts) * 60 + minute(out_ts) AS rawLastOutMins,
  CASE WHEN NOT single THEN cents / 100.0 END AS hours,
  punch_count, Punches
FROM k"""


# The fields of the CSV report and the names an upload header must have.
CSV_FIELDS = ("EmployeeID", "FirstName", "LastName", "Department", "Date", "Weekday", "FirstIn", "LastOut", "TotalHours", "Status")
REQUIRED_HEADERS = ("EmployeeID", "Name", "Department", "Timestamp")

B_COLS = (
    "EmployeeID, FirstName, LastName, Name, Department, EmpType, Date, rawDate, Weekday, FirstIn, LastOut, "
    "TotalHours, Status, rawFirstInMins, rawLastOutMins, hours, punch_count"
)


def _half_up(num: str, den: str) -> str:
    return f"(({num}) * 2 + ({den})) // (({den}) * 2)"


def report_sql() -> dict[str, str]:
    ra = records_a()
    out = {
        "daily_attendance": f"SELECT {A_COLS} FROM ({ra})",
        "daily_attendance_filtered": f"SELECT {A_COLS} FROM ({_records_filtered()})",
        "daily_attendance_by_status": f"SELECT {A_COLS} FROM ({records_a(where_status=repr(Q.FILTER_STATUS) + ' = Status')})",
        "status_distribution": f"""
WITH r AS ({ra}), s(Status) AS (VALUES ('ONTIME'), ('OVERTIME'), ('LATE_ENTRY_AND_LATE_EXIT'),
  ('LATE_ENTRY_AND_EARLY_EXIT'), ('EARLY_DEPARTURE'))
SELECT s.Status, (SELECT count(*) FROM r WHERE r.Status = s.Status) AS Count FROM s""",
        "daily_trend": f"""
WITH r AS ({ra})
SELECT Date AS date, {_half_up('sum(hours_cents)', 'count(hours_cents)')} / 100.0 AS avgHours
FROM r WHERE Status <> 'Incomplete Record' GROUP BY Date""",
        "active_punches": f"""
WITH users AS ({USERS}), depts AS ({DEPTS}), punches AS ({PUNCHES})
SELECT p.EmployeeNo, u.FirstName, u.LastName, d.DepartmentName, u.EmpType,
       strftime(CAST(p.PunchDateTime AS DATE), '%Y-%m-%d') AS LogDate, strftime(p.PunchDateTime, '%H:%M:%S') AS LogTime
FROM punches p JOIN users u ON u.EmployeeNo = p.EmployeeNo JOIN depts d ON d.DepartmentID = u.DepartmentID
WHERE u.IsActive""",
        "summary_widgets": f"""
WITH r AS ({ra})
SELECT count(DISTINCT EmployeeID) AS total_employees, count(*) AS records,
       count(*) FILTER (WHERE upper(Status) = 'INCOMPLETE RECORD') AS incomplete,
       CASE WHEN count(hours_cents) > 0 THEN {fixed2(_half_up('sum(hours_cents)', 'count(hours_cents)'))} ELSE '0.00' END AS avg_hours
FROM r""",
        "time_bands": f"""
WITH r AS ({ra}),
m AS (
  SELECT *,
    CASE WHEN FirstIn IN ('-') OR lower(FirstIn) LIKE '%missing%' THEN NULL
         ELSE CAST(split_part(FirstIn, ':', 1) AS BIGINT) * 60 + CAST(split_part(FirstIn, ':', 2) AS BIGINT) END AS inm,
    CASE WHEN LastOut IN ('-') OR lower(LastOut) LIKE '%missing%' THEN NULL
         ELSE CAST(split_part(LastOut, ':', 1) AS BIGINT) * 60 + CAST(split_part(LastOut, ':', 2) AS BIGINT) END AS outm
  FROM r
)
SELECT EmployeeID, Date,
  CASE WHEN inm BETWEEN 420 AND 524 THEN 'primary' WHEN inm BETWEEN 525 AND 550 THEN 'success'
       WHEN inm BETWEEN 551 AND 585 THEN 'warning' WHEN inm >= 586 THEN 'danger' ELSE '' END AS in_band,
  CASE WHEN outm <= 1064 THEN 'danger' WHEN outm BETWEEN 1065 AND 1079 THEN 'warning'
       WHEN outm BETWEEN 1080 AND 1139 THEN 'success' WHEN outm >= 1140 THEN 'primary' ELSE '' END AS out_band,
  CASE WHEN TotalHours = '-' THEN 'Incomplete' WHEN hours >= 10 THEN 'info' WHEN hours >= 9 THEN 'success'
       WHEN hours >= 8 THEN 'warning' ELSE 'danger' END AS hours_band,
  CASE upper(Status) WHEN 'ONTIME' THEN 'success' WHEN 'EARLY_DEPARTURE' THEN 'warning'
       WHEN 'LATE_ENTRY_AND_LATE_EXIT' THEN 'warning' WHEN 'LATE_ENTRY_AND_EARLY_EXIT' THEN 'danger'
       WHEN 'OVERTIME' THEN 'info' ELSE 'secondary' END AS severity,
  upper(Status) = 'INCOMPLETE RECORD' AS flagged
FROM m""",
        "employee_compliance": f"""
WITH r AS ({ra}),
g AS (
  SELECT EmployeeID, max(Name) AS Name, count(*) AS TotalDays, coalesce(sum(hours_cents), 0) AS cents,
         count(*) FILTER (WHERE upper(Status) LIKE '%LATE_ENTRY%') AS LateCount,
         count(*) FILTER (WHERE upper(Status) LIKE '%EARLY_EXIT%' OR upper(Status) = 'EARLY_DEPARTURE') AS EarlyCount
  FROM r GROUP BY EmployeeID
),
s AS (SELECT *, least({_half_up('cents * 10', 'TotalDays * 9')}, 1000) / 10.0 AS pct FROM g)
SELECT EmployeeID, Name, TotalDays, LateCount, EarlyCount, cents / 100.0 AS TotalHoursWorked,
       TotalDays * 9 AS ExpectedHours, pct AS CompliancePct,
       CASE WHEN pct < 75 THEN 'danger' WHEN pct < 90 THEN 'warning' ELSE 'success' END AS ComplianceBand
FROM s""",
        "records_page": f"""
SELECT {A_COLS} FROM ({ra})
ORDER BY coalesce(hours, 0) DESC, Date DESC, EmployeeID ASC
LIMIT {Q.PAGE_SIZE} OFFSET {(Q.PAGE_NUMBER - 1) * Q.PAGE_SIZE}""",
        "punch_timeline": f"""
WITH r AS ({ra})
SELECT EmployeeID, Name, Date, 1 AS seq, 'First Check In' AS event, FirstIn AS time FROM r
UNION ALL
SELECT EmployeeID, Name, Date, 2 AS seq, 'Last Check Out' AS event,
       CASE WHEN LastOut IS NULL OR LastOut IN ('Missing Checkout', '-') THEN 'Missing checkout registration' ELSE LastOut END
FROM r""",
        "export_daily": f"SELECT {B_COLS}, Punches FROM ({records_b()})",
        "export_filtered": f"""
SELECT {B_COLS} FROM ({records_b()})
WHERE rawDate >= '{Q.FILTER_START}' AND rawDate <= '{Q.FILTER_END}'
  AND lower({js_trim('Department')}) = '{Q.EXPORT_DEPARTMENT.strip().lower()}'
  AND lower({js_trim('Status')}) = '{Q.EXPORT_STATUS.strip().lower()}'
  AND (lower(Name) LIKE '%{Q.EXPORT_SEARCH.lower()}%' OR lower(EmployeeID) LIKE '%{Q.EXPORT_SEARCH.lower()}%')""",
    }
    return out


# ---------------------------------------------------------------------------
# Ingestion and roster oracles
# ---------------------------------------------------------------------------

FACILITIES_SQL = "('SERVER ROOM-IN', 'SERVER ROOM-OUT', 'STORE ROOM-IN', 'HUB ROOM-IN', 'HUB ROOM-OUT', 'Q2-ELECTRICAL ROOM-IN', 'Q3 ELE ROOM-IN')"


def normalize_sql(x: str) -> str:
    s = js_trim(f"coalesce({x}, '')")
    s = f"regexp_replace({s}, '^null\\s+', '', 'i')"
    s = f"regexp_replace({s}, '\\s+null$', '', 'i')"
    s = f"regexp_replace({s}, '\\(.*?\\)', '', 'g')"
    s = f"regexp_replace({s}, '\\d+', '', 'g')"
    s = f"regexp_replace({s}, '[.,/#!$%^&*;:{{}}=\\-_`~?]', ' ', 'g')"
    s = js_trim(f"regexp_replace({s}, '\\s+', ' ', 'g')")
    return f"array_to_string(list_filter(string_split({s}, ' '), lambda w: length(w) > 1), ' ')"


def name_key_sql(x: str) -> str:
    return f"regexp_replace(lower({js_trim(f'coalesce({x}, {chr(39)}{chr(39)})')}), '\\s+', '', 'g')"


NAMED_USERS = """
SELECT c.c_custkey + 1 AS UserID, CAST(c.c_custkey AS VARCHAR) AS EmployeeNo,
       coalesce(string_split(p.p_name, ' ')[1], '') AS FirstName,
       coalesce(string_split(p.p_name, ' ')[-1], c.c_name) AS LastName
FROM customer c LEFT JOIN part p ON p.p_partkey = c.c_custkey"""


def cascade_sql(upload: str, users: str = NAMED_USERS) -> str:
    """CTEs resolving identity for ``up``(rec, id_cell, first_cell, last_cell, unified_cell, ...) → ``lab``."""
    nk_f, nk_l = name_key_sql("FirstName"), name_key_sql("LastName")
    full = js_trim("first_cell || ' ' || last_cell")
    return f"""
up AS ({upload}),
users AS ({users}),
keys AS (SELECT DISTINCT upper({js_trim('EmployeeNo')}) AS key FROM users),
nu AS (SELECT UserID, EmployeeNo, {nk_f} AS f, {nk_l} AS l FROM users),
ent AS (
  SELECT UserID, EmployeeNo, f || l AS key, 0 AS slot FROM nu WHERE f <> '' AND l <> ''
  UNION ALL SELECT UserID, EmployeeNo, l || f, 1 FROM nu WHERE f <> '' AND l <> ''
  UNION ALL SELECT UserID, EmployeeNo, f, 0 FROM nu WHERE f <> '' AND l = ''
  UNION ALL SELECT UserID, EmployeeNo, l, 0 FROM nu WHERE f = '' AND l <> ''
),
idx AS (SELECT key, arg_max(EmployeeNo, UserID * 2 + slot) AS emp, min(UserID * 2 + slot) AS pos FROM ent GROUP BY key),
r AS (
  SELECT up.*, upper({js_trim("coalesce(id_cell, '')")}) AS raw_id,
         {normalize_sql(f"CASE WHEN {full} <> '' THEN {full} ELSE {js_trim('unified_cell')} END")} AS norm
  FROM up
),
r2 AS (
  SELECT r.*, (raw_id NOT IN ('', '16777985', '0', 'NULL') AND raw_id IN (SELECT key FROM keys)) AS by_id FROM r
),
nm AS (SELECT DISTINCT norm, first_cell FROM r2 WHERE NOT by_id),
nw AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: length(x) > 0) AS w FROM nm),
cand AS (
  SELECT norm, first_cell, 0 AS prio, regexp_replace(lower(norm), '\\s+', '', 'g') AS key FROM nm WHERE norm <> ''
  UNION ALL SELECT norm, first_cell, 1, lower(w[1]) || lower(w[2]) FROM nw WHERE len(w) >= 2
  UNION ALL SELECT norm, first_cell, 2, lower(w[2]) || lower(w[1]) FROM nw WHERE len(w) >= 2
  UNION ALL SELECT norm, first_cell, 3, lower(w[1]) || lower(w[-1]) FROM nw WHERE len(w) >= 2
  UNION ALL SELECT norm, first_cell, 4, lower(w[-1]) || lower(w[1]) FROM nw WHERE len(w) >= 2
),
hit AS (
  SELECT norm, first_cell, arg_min(emp, prio) AS emp, min(prio) AS prio
  FROM cand JOIN idx USING (key) WHERE emp <> '' GROUP BY norm, first_cell
),
needles AS (
  SELECT DISTINCT lower({js_trim('nm.first_cell')}) AS needle FROM nm LEFT JOIN hit USING (norm, first_cell)
  WHERE hit.emp IS NULL AND nm.first_cell <> '' AND length(lower({js_trim('nm.first_cell')})) > 2
),
loose AS (SELECT needle, arg_min(emp, pos) AS emp FROM needles JOIN idx ON contains(idx.key, needles.needle) GROUP BY needle),
res AS (
  SELECT nm.norm, nm.first_cell, coalesce(hit.emp, loose.emp) AS matched,
         CASE WHEN hit.prio = 0 THEN 'exact' WHEN hit.prio IS NOT NULL THEN 'words'
              WHEN loose.emp IS NOT NULL THEN 'loose' END AS method
  FROM nm LEFT JOIN hit USING (norm, first_cell) LEFT JOIN loose ON loose.needle = lower({js_trim('nm.first_cell')})
),
fin AS (
  SELECT r2.*, res.matched, res.method, coalesce(res.matched IN (SELECT key FROM keys), FALSE) AS mk
  FROM r2 LEFT JOIN res USING (norm, first_cell)
),
lab AS (
  SELECT fin.*,
    CASE WHEN by_id THEN raw_id WHEN (NOT by_id AND mk) THEN matched WHEN raw_id = '' THEN 'NOT PROVIDED' ELSE raw_id END AS EmployeeNo,
    (NOT by_id AND NOT (NOT by_id AND mk)) AS unauth,
    CASE WHEN by_id THEN 'id' WHEN (NOT by_id AND mk) THEN method ELSE 'none' END AS match_method
  FROM fin
)"""


DEVICE_CASE = (
    "coalesce(CASE e.event_type WHEN 'view' THEN 'MAIN GATE-IN' WHEN 'click' THEN 'MAIN GATE-OUT' "
    "WHEN 'purchase' THEN 'CAFETERIA-IN' WHEN 'signup' THEN 'SERVER ROOM-IN' WHEN 'error' THEN 'MAIN GATE-IN' END, e.event_type)"
)

EVENT_UPLOAD = f"""
SELECT e.event_id AS rec,
       CASE WHEN e.event_type = 'error' THEN '0' ELSE CAST(e.user_id AS VARCHAR) END AS id_cell,
       coalesce(string_split(p.p_name, ' ')[1], '') AS first_cell,
       coalesce(string_split(p.p_name, ' ')[-1], '') AS last_cell,
       '' AS unified_cell,
       strftime(e.ts, '%d-%m-%Y') AS date_cell, strftime(e.ts, '%H:%M') AS time_cell,
       {DEVICE_CASE} AS device_cell, coalesce(e.props, '') AS area_cell
FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id"""


def _ingest_ctes() -> str:
    return f"""WITH {cascade_sql(EVENT_UPLOAD)},
lab2 AS (
  SELECT rec, EmployeeNo, unauth, match_method, {js_trim('device_cell')} AS dev, {js_trim('area_cell')} AS area,
         strptime(date_cell || ' ' || time_cell, '%d-%m-%Y %H:%M') AS ts
  FROM lab
),
kept AS (SELECT * FROM lab2 WHERE dev NOT IN {FACILITIES_SQL} AND ts IS NOT NULL)"""


SUPPLIER_USERS = """
SELECT CAST(s_suppkey + 1 AS INTEGER) AS UserID, CAST(s_suppkey AS VARCHAR) AS EmployeeNo, '' AS FirstName, s_name AS LastName,
       s_nationkey AS DepartmentID, 'User' AS Role, CAST(NULL AS VARCHAR) AS EmpType, s_acctbal >= 0 AS IsActive
FROM supplier"""


def _sync_ctes() -> str:
    return f"""
WITH ex AS ({SUPPLIER_USERS}), dep AS ({DEPTS}),
rows AS (
  SELECT c_custkey AS ord, upper({js_trim('CAST(c_custkey AS VARCHAR)')}) AS staff, '' AS first,
         CASE WHEN upper({js_trim('c_name')}) = 'NULL' THEN '' ELSE {js_trim('c_name')} END AS last,
         {js_trim("coalesce(nullif(c_mktsegment, ''), 'IT')")} AS dept_name,
         CASE WHEN c_acctbal >= 0 THEN 'Permanent' ELSE 'Contract' END AS emp_type
  FROM customer
),
kept AS (SELECT * FROM rows WHERE staff <> ''),
seen AS (SELECT lower({js_trim('dept_name')}) AS dkey, arg_min(dept_name, ord) AS DepartmentName, min(ord) AS first_ord FROM kept GROUP BY 1),
newd AS (
  SELECT CAST((SELECT coalesce(max(DepartmentID), 0) FROM dep) + row_number() OVER (ORDER BY first_ord) AS INTEGER) AS DepartmentID, DepartmentName
  FROM seen WHERE dkey NOT IN (SELECT lower({js_trim('DepartmentName')}) FROM dep)
),
alld AS (SELECT DepartmentID, DepartmentName FROM dep UNION ALL SELECT DepartmentID, DepartmentName FROM newd),
lk AS (SELECT lower({js_trim('DepartmentName')}) AS dkey, max(DepartmentID) AS DepartmentID FROM alld GROUP BY 1),
rj AS (SELECT kept.*, lk.DepartmentID FROM kept LEFT JOIN lk ON lk.dkey = lower({js_trim('kept.dept_name')})),
ps AS (
  SELECT staff, arg_max(first, ord) AS first, arg_max(last, ord) AS last, arg_max(DepartmentID, ord) AS DepartmentID,
         arg_max(emp_type, ord) AS emp_type, min(ord) AS first_ord, count(*) AS n_rows,
         staff IN (SELECT upper({js_trim('EmployeeNo')}) FROM ex) AS ex_hit
  FROM rj GROUP BY staff
),
upd AS (
  SELECT ex.UserID, ex.EmployeeNo,
         CASE WHEN ps.staff IS NOT NULL THEN ps.first ELSE ex.FirstName END AS FirstName,
         CASE WHEN ps.staff IS NOT NULL THEN ps.last ELSE ex.LastName END AS LastName,
         CASE WHEN ps.staff IS NOT NULL THEN ps.DepartmentID ELSE ex.DepartmentID END AS DepartmentID,
         ex.Role,
         CASE WHEN ps.staff IS NOT NULL THEN ps.emp_type ELSE ex.EmpType END AS EmpType,
         ex.IsActive
  FROM ex LEFT JOIN ps ON ps.staff = upper({js_trim('ex.EmployeeNo')})
),
ins AS (
  SELECT CAST((SELECT coalesce(max(UserID), 0) FROM ex) + row_number() OVER (ORDER BY first_ord) AS INTEGER) AS UserID,
         staff AS EmployeeNo, first AS FirstName, last AS LastName, DepartmentID, 'User' AS Role, emp_type AS EmpType,
         TRUE AS IsActive
  FROM ps WHERE NOT ex_hit
)"""


ADMIN = """
SELECT s_suppkey AS req_ord, ' s' || CAST(s_suppkey AS VARCHAR) AS employeeNo, ' ' || s_name || ' ' AS firstName,
       CASE WHEN s_acctbal >= 0 THEN 'Vendor' ELSE '' END AS lastName, CAST(s_nationkey AS VARCHAR) AS departmentId,
       'User' AS role, 'pw' AS password, s_suppkey, s_acctbal
FROM supplier"""

DIR_COLS = "EmployeeNo, FirstName, LastName, DepartmentID, DepartmentName, EmpType, Role, IsActive"
USER_COLS = "UserID, EmployeeNo, FirstName, LastName, DepartmentID, Role, EmpType, IsActive"


def ingest_sql() -> dict[str, str]:
    ing = _ingest_ctes()
    dt_layouts = {
        "view": ("%Y-%m-%d", "%H:%M:%S", "second"),
        "click": ("%d-%m-%Y", "%-H:%M:%S", "second"),
        "purchase": ("%m/%d/%Y", "%H:%M", "minute"),
        "signup": ("%-d %b %Y", "%-H:%M:%S", "second"),
        "error": ("%-m/%-d/%Y", "%-H:%-M:%-S", "second"),
    }
    dcase = " ".join(f"WHEN '{k}' THEN strftime(ts, '{v[0]}')" for k, v in dt_layouts.items())
    tcase = " ".join(f"WHEN '{k}' THEN strftime(ts, '{v[1]}')" for k, v in dt_layouts.items())
    pcase = " ".join(f"WHEN '{k}' THEN date_trunc('{v[2]}', ts)" for k, v in dt_layouts.items())
    upload_parts = """
SELECT p_partkey AS rec, '0' AS id_cell,
  CASE p_size % 4 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN string_split(p_name, ' ')[-1]
       WHEN 2 THEN upper(string_split(p_name, ' ')[1]) || ' Q.' ELSE substring(string_split(p_name, ' ')[1], 1, 4) END AS first_cell,
  CASE p_size % 4 WHEN 0 THEN string_split(p_name, ' ')[-1] WHEN 1 THEN string_split(p_name, ' ')[1]
       WHEN 2 THEN string_split(p_name, ' ')[-1] || ' 07' ELSE '' END AS last_cell,
  '' AS unified_cell
FROM part"""
    serial_ts = (
        "make_timestamp(((CAST(date_cell AS BIGINT) - 25569) * 86400 + (tot // 3600) * 3600 + ((tot % 3600) // 60) * 60) * 1000000)"
    )
    return {
        "punch_ingest": f"""{ing}
SELECT EmployeeNo, strftime(ts, '%Y-%m-%d %H:%M:%S') AS PunchDateTime,
  CASE WHEN arg_min(dev, rec) <> '' THEN arg_min(dev, rec) END AS DeviceName,
  CASE WHEN arg_min(area, rec) <> '' THEN arg_min(area, rec) END AS AreaName,
  CASE WHEN arg_min(unauth, rec) THEN 'Unauthorized Entry' END AS Status,
  arg_min(match_method, rec) AS match_method
FROM kept GROUP BY EmployeeNo, ts""",
        "punch_stream": f"""{ing}
SELECT EmployeeNo, strftime(ts, '%Y-%m-%d %H:%M:%S') AS PunchDateTime FROM kept GROUP BY EmployeeNo, ts""",
        "ingest_metrics": f"""{ing},
g AS (SELECT EmployeeNo, ts, count(*) AS n FROM kept GROUP BY 1, 2)
SELECT (SELECT count(*) FROM g) AS importedRows, CAST((SELECT coalesce(sum(n - 1), 0) FROM g) AS BIGINT) AS skippedDuplicates,
       CAST(0 AS BIGINT) AS autoProvisionedUsers, CAST(0 AS BIGINT) AS autoProvisionedDepartments,
       (SELECT count(*) FILTER (WHERE unauth) FROM lab2) AS unauthorizedRecords""",
        "facility_exclusion": f"""
WITH u AS ({EVENT_UPLOAD})
SELECT {js_trim('device_cell')} AS DeviceName, {js_trim('device_cell')} IN {FACILITIES_SQL} AS excluded, count(*) AS rows
FROM u GROUP BY 1, 2""",
        "punch_dedup": f"""{ing}
SELECT EmployeeNo, strftime(ts, '%Y-%m-%d %H:%M:%S') AS PunchDateTime, count(*) AS copies, arg_min(dev, rec) AS KeptDevice
FROM kept GROUP BY EmployeeNo, ts HAVING count(*) > 1""",
        "datetime_parse": f"""
SELECT event_id, CASE event_type {dcase} END AS date_cell, CASE event_type {tcase} END AS time_cell,
       strftime(CASE event_type {pcase} END, '%Y-%m-%d %H:%M:%S') AS parsed
FROM events""",
        "excel_serial_parse": f"""
WITH c AS (
  SELECT event_id, CAST(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS VARCHAR) AS date_cell,
         '0.' || lpad(CAST(((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 2000000 + 86400) // 172800 AS VARCHAR), 6, '0') AS time_cell
  FROM events
), t AS (SELECT *, CAST(floor(CAST(time_cell AS DOUBLE) * 24 * 60 * 60 + 0.5) AS BIGINT) AS tot FROM c)
SELECT event_id, date_cell, time_cell, strftime({serial_ts}, '%Y-%m-%d %H:%M:%S') AS parsed FROM t""",
        "name_normalize": f"""
WITH p AS (SELECT p_partkey, 'NULL ' || upper(p_name) || ' (' || p_brand || ') ' || CAST(p_size AS VARCHAR) || ' x.' AS raw FROM part)
SELECT p_partkey, raw, {normalize_sql('raw')} AS normalized FROM p""",
        "name_match": f"""WITH {cascade_sql(upload_parts)}
SELECT rec AS p_partkey, first_cell, last_cell, EmployeeNo, unauth AS unauthorized, match_method FROM lab""",
    }


def roster_sql() -> dict[str, str]:
    sync = _sync_ctes()
    users = f"WITH users AS ({USERS}), depts AS ({DEPTS})"
    return {
        "roster_upsert": f"{sync}\nSELECT {USER_COLS} FROM upd UNION ALL SELECT {USER_COLS} FROM ins",
        "roster_metrics": f"""{sync}
SELECT CAST(coalesce(sum(n_rows), 0) AS BIGINT) AS importedRows,
       CAST(coalesce(sum(CASE WHEN ex_hit THEN n_rows ELSE n_rows - 1 END), 0) AS BIGINT) AS skippedDuplicates,
       count(*) FILTER (WHERE NOT ex_hit) AS autoProvisionedUsers,
       (SELECT count(*) FROM newd) AS autoProvisionedDepartments,
       CAST(0 AS BIGINT) AS unauthorizedRecords
FROM ps""",
        "department_provision": f"{sync}\nSELECT DepartmentID, DepartmentName FROM alld",
        "directory": f"{users}\nSELECT u.EmployeeNo, u.FirstName, u.LastName, u.DepartmentID, d.DepartmentName, u.EmpType, u.Role, u.IsActive FROM users u LEFT JOIN depts d USING (DepartmentID)",
        "directory_strict": f"{users}\nSELECT u.EmployeeNo, u.FirstName, u.LastName, u.DepartmentID, d.DepartmentName, u.EmpType, u.Role, u.IsActive FROM users u JOIN depts d USING (DepartmentID)",
        "directory_filter": f"""{users},
f AS (
  SELECT u.EmployeeNo, coalesce(nullif(u.FirstName, ''), '') AS FirstName, coalesce(nullif(u.LastName, ''), '') AS LastName,
         u.DepartmentID, coalesce(nullif(d.DepartmentName, ''), 'Unassigned') AS DepartmentName,
         coalesce(nullif(u.EmpType, ''), 'Regular') AS EmpType, coalesce(nullif(u.Role, ''), 'User') AS Role,
         coalesce(u.IsActive, FALSE) AS IsActive
  FROM users u LEFT JOIN depts d USING (DepartmentID)
)
SELECT * FROM f WHERE IsActive AND (contains(lower(EmployeeNo), '{Q.DIRECTORY_QUERY}')
  OR contains(lower(FirstName || ' ' || LastName), '{Q.DIRECTORY_QUERY}') OR contains(lower(DepartmentName), '{Q.DIRECTORY_QUERY}'))""",
        "departments_list": f"{DEPTS}",
        "users_create": f"""{users}, req AS ({ADMIN}),
ok AS (
  SELECT * FROM req WHERE coalesce(employeeNo, '') <> '' AND coalesce(firstName, '') <> '' AND coalesce(lastName, '') <> ''
    AND coalesce(departmentId, '') <> '' AND coalesce(role, '') <> '' AND coalesce(password, '') <> ''
    AND upper({js_trim('employeeNo')}) NOT IN (SELECT upper({js_trim('EmployeeNo')}) FROM users)
)
SELECT {USER_COLS} FROM users
UNION ALL
SELECT CAST((SELECT max(UserID) FROM users) + row_number() OVER (ORDER BY req_ord) AS INTEGER), upper({js_trim('employeeNo')}),
       {js_trim('firstName')}, {js_trim('lastName')}, CAST(departmentId AS INTEGER), role, CAST(NULL AS VARCHAR), TRUE
FROM ok""",
        "users_update": f"""{users}, req AS ({ADMIN}),
ch AS (
  SELECT upper(CAST(s_suppkey AS VARCHAR)) AS k, {js_trim('firstName')} AS f, {js_trim('lastName')} AS l,
         CAST(departmentId AS INTEGER) AS d, role AS r
  FROM req WHERE coalesce(firstName, '') <> '' AND coalesce(lastName, '') <> '' AND coalesce(departmentId, '') <> '' AND coalesce(role, '') <> ''
)
SELECT u.UserID, u.EmployeeNo, coalesce2.FirstName, coalesce2.LastName, coalesce2.DepartmentID, coalesce2.Role, u.EmpType, u.IsActive
FROM users u LEFT JOIN ch ON ch.k = upper(u.EmployeeNo),
LATERAL (SELECT CASE WHEN ch.k IS NOT NULL THEN ch.f ELSE u.FirstName END AS FirstName,
                CASE WHEN ch.k IS NOT NULL THEN ch.l ELSE u.LastName END AS LastName,
                CASE WHEN ch.k IS NOT NULL THEN ch.d ELSE u.DepartmentID END AS DepartmentID,
                CASE WHEN ch.k IS NOT NULL THEN ch.r ELSE u.Role END AS Role) coalesce2""",
        "users_set_active": f"""{users}, req AS ({ADMIN}),
ch AS (SELECT upper(CAST(s_suppkey AS VARCHAR)) AS k, coalesce(CASE WHEN s_acctbal > 5000 THEN TRUE WHEN s_acctbal > 0 THEN NULL ELSE FALSE END, FALSE) AS flag FROM req)
SELECT u.UserID, u.EmployeeNo, u.FirstName, u.LastName, u.DepartmentID, u.Role, u.EmpType,
       CASE WHEN ch.k IS NOT NULL THEN ch.flag ELSE u.IsActive END AS IsActive
FROM users u LEFT JOIN ch ON ch.k = upper(u.EmployeeNo)""",
    }


def small_sql() -> dict[str, str]:
    ra, rough = records_a(), ROUGH_PUNCHES
    within = f"CAST(PunchDateTime AS DATE) BETWEEN DATE '{Q.FILTER_START}' AND DATE '{Q.FILTER_END}'"
    group = f"CASE WHEN coalesce(EmployeeNo, '') = '' THEN 'UNKNOWN' ELSE {js_trim('EmployeeNo')} END"
    cells = [f"'\"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '\"', '\"\"') || '\"'" for c in CSV_FIELDS]
    needs = ", ".join(f"CASE WHEN p_size % 7 = 0 OR p_size % 5 = {i} THEN '{h}' END" for i, h in enumerate(REQUIRED_HEADERS))
    stamp = "strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')"
    reports = report_sql()
    return {
        "all_punches": f"""
WITH users AS ({USERS}), depts AS ({DEPTS}), punches AS ({rough})
SELECT LogID, p.EmployeeNo, strftime(PunchDateTime, '%Y-%m-%d %H:%M:%S') AS PunchDateTime, Status AS LogStatus,
       FirstName, LastName, EmpType, DepartmentName AS Department
FROM punches p LEFT JOIN users u ON u.EmployeeNo = p.EmployeeNo LEFT JOIN depts d ON d.DepartmentID = u.DepartmentID""",
        "export_rough": f"SELECT {B_COLS}, Punches FROM ({records_b(rough)})",
        "export_repeated_users": f"SELECT {B_COLS} FROM ({records_b(rough)})",
        "punch_list": f"""
WITH days AS (SELECT EmployeeID, rawDate FROM ({records_b(rough, within)}) WHERE Status = 'Unauthorized Entry'),
p AS (
  SELECT {group} AS EmployeeID, strftime(PunchDateTime, '%Y-%m-%d') AS rawDate,
         strftime(PunchDateTime, '%Y-%m-%d %H:%M:%S') AS PunchDateTime, LogID, strftime(PunchDateTime, '%-I:%M %p') AS Punch
  FROM ({rough}) WHERE {within}
)
SELECT p.* FROM p SEMI JOIN days USING (EmployeeID, rawDate)""",
        "report_csv_lines": f"SELECT {" || ',' || ".join(cells)} AS line FROM ({records_b(rough)})",
        "upload_csv": """
SELECT event_id, 'said "' || event_type || '", at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS note, event_type AS kind,
       CASE WHEN event_id % 3 = 0 THEN props END AS props
FROM events""",
        "punches_stored": f"SELECT EmployeeNo, strftime(PunchDateTime, '%Y-%m-%d %H:%M:%S') AS PunchDateTime, Status FROM ({PUNCHES})",
        "export_written": f"SELECT {" || ',' || ".join(cells)} AS line FROM ({records_b(rough)})",
        "header_check": f"""
WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS upload_id, concat_ws(',', {needs}) AS missing FROM part)
SELECT upload_id, missing = '' AS valid, missing FROM m""",
        "missing_columns": f"""
SELECT UserID, EmployeeNo, FirstName, LastName, CAST(DepartmentID AS INTEGER) AS DepartmentID, CAST(NULL AS VARCHAR) AS Role,
       CAST(NULL AS VARCHAR) AS EmpType, IsActive FROM ({USERS})""",
        "export_audit": f"""
SELECT '[' || {stamp} || '] USER: User ' || user_id || ' (ADID: ' || user_id || ') | ACTION: Export ' || upper(event_type)
       || ' | FILTERS: {{"format":"' || event_type || '","search":"' || user_id || '"}}' AS value
FROM events""",
        "session_audit": f"""
SELECT '[' || {stamp} || '] ACTION: ' || upper(event_type) || ' | User ID: ' || user_id || ' | Name: User ' || user_id
       || ' | Role: User' || CASE WHEN event_type = 'error' THEN ' | Status: FAILED' ELSE '' END AS value
FROM events""",
        "merge_datetime": """
WITH c AS (
  SELECT event_id, ts,
         CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(event_id % 24, ':', event_id % 60)
              ELSE concat(event_id % 24, ':', event_id % 60, ':7') END AS time_cell,
         date_trunc('day', ts) + to_seconds((event_id % 24) * 3600 + (event_id % 60) * 60 + CASE event_id % 4 WHEN 3 THEN 7 ELSE 0 END) AS m
  FROM events
)
SELECT event_id, time_cell, strftime(CASE WHEN coalesce(time_cell, '') = '' THEN ts ELSE m END, '%Y-%m-%d %H:%M:%S') AS merged FROM c""",
        "datetime_rough": """
WITH c AS (
  SELECT event_id, ts, event_id % 7 AS kind,
         CASE event_id % 7 WHEN 0 THEN strftime(ts, '%-d %b %Y') WHEN 1 THEN strftime(ts, '%m.%d.%Y') WHEN 2 THEN strftime(ts, '%Y-%m-%d')
              WHEN 3 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS VARCHAR) WHEN 4 THEN '35-' || strftime(ts, '%m-%Y')
              WHEN 5 THEN '' ELSE 'no date' END AS date_cell,
         CASE event_id % 7 WHEN 0 THEN strftime(ts, '%-I:%M %p') WHEN 2 THEN strftime(ts, ':%M') ELSE strftime(ts, '%-H:%M') END AS time_cell
  FROM events
)
SELECT event_id, date_cell, time_cell,
       strftime(CASE WHEN kind IN (0, 1, 3) THEN date_trunc('minute', ts)
                     WHEN kind = 2 THEN date_trunc('day', ts) + to_minutes(minute(ts))
                     WHEN kind = 4 THEN date_trunc('month', ts) + to_days(34) + to_minutes(hour(ts) * 60 + minute(ts)) END,
                '%Y-%m-%d %H:%M:%S') AS parsed
FROM c""",
        "daily_ordered": f"SELECT {A_COLS} FROM ({ra}) ORDER BY Date DESC, EmployeeID",
        "dashboard_bundle": f"""
SELECT 'trend' AS chart, date AS label, CAST(avgHours AS DOUBLE) AS value FROM ({reports['daily_trend']})
UNION ALL SELECT 'distribution', Status, CAST(Count AS DOUBLE) FROM ({reports['status_distribution']})
UNION ALL SELECT 'employee', EmployeeID, CAST(CompliancePct AS DOUBLE) FROM ({reports['employee_compliance']})""",
        "trend_bands": f"""
SELECT date, avgHours, CASE WHEN avgHours >= 10 THEN 'info' WHEN avgHours >= 9 THEN 'success' WHEN avgHours >= 8 THEN 'warning' ELSE 'danger' END AS band
FROM ({reports['daily_trend']})""",
        "page_totals": f"SELECT count(*) AS total, CAST(ceil(count(*) / {Q.PAGE_SIZE}.0) AS BIGINT) AS pages FROM ({ra})",
        "clock_texts": f"""
WITH c AS (
  SELECT event_id, {stamp} AS india,
         CASE event_id % 4 WHEN 0 THEN strftime(ts, '%-H:%M') WHEN 1 THEN strftime(ts, '%-H') WHEN 2 THEN strftime(ts, 'x:%M') END AS text,
         CASE event_id % 4 WHEN 0 THEN hour(ts) * 60 + minute(ts) WHEN 1 THEN hour(ts) * 60 WHEN 2 THEN minute(ts) ELSE 0 END AS minutes
  FROM events
)
SELECT event_id, text, minutes, india,
       concat(CASE WHEN (minutes // 60) % 12 = 0 THEN 12 ELSE (minutes // 60) % 12 END, ':', lpad(CAST(minutes % 60 AS VARCHAR), 2, '0'),
              CASE WHEN minutes >= 720 THEN ' PM' ELSE ' AM' END) AS clock
FROM c""",
    }


def all_sql() -> dict[str, str]:
    return {**report_sql(), **ingest_sql(), **roster_sql(), **small_sql()}
