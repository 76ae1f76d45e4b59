"""Fixed values and shift rules.

Everything here is data, so the two report variants can keep their own rules
(they differ on purpose: late threshold, overtime rounding and precedence,
single-punch handling, labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for matching results)
# ---------------------------------------------------------------------------

# Internal door devices whose punches are not attendance (exact, case-sensitive).
INTERNAL_FACILITIES = (
    "SERVER ROOM-IN",
    "SERVER ROOM-OUT",
    "STORE ROOM-IN",
    "HUB ROOM-IN",
    "HUB ROOM-OUT",
    "Q2-ELECTRICAL ROOM-IN",
    "Q3 ELE ROOM-IN",
)

# Badge IDs a reader emits when it could not read a card.
DUMMY_IDS = ("", "16777985", "0", "NULL")

# Header aliases, in lookup order.
ROSTER_ID_ALIASES = ("Staff No.", "Staff No", "StaffNo", "EmployeeNo", "PersonNo", "Person No", "Staff ID")
PUNCH_ID_ALIASES = ("PersonNo", "EmployeeNo", "Person No", "Staff ID", "Staff No.", "Staff No", "StaffNo")
DEPARTMENT_ALIASES = ("Department", "DepartmentName", "Department Name")
EMPTYPE_ALIASES = ("Emp.Type", "EmpType", "Employment Type", "EmploymentType")
ROSTER_FIRST_ALIASES = ("First Name", "FirstName")
ROSTER_LAST_ALIASES = ("Last Name", "LastName")
UNIFIED_NAME_ALIASES = ("Name", "FullName", "Full Name")
PUNCH_FIRST_ALIASES = ("PersonFirstName", "Person First Name", "FirstName", "First Name")
PUNCH_LAST_ALIASES = ("PersonLastName", "Person Last Name", "LastName", "Last Name")
DEVICE_ALIASES = ("DeviceName", "Device")
AREA_ALIASES = ("AreaName", "Area")
DATE_ALIASES = ("DATE", "Date")
TIME_ALIASES = ("TIME", "Time")

# Header contract of the upload check; all must be present, exact match.
REQUIRED_UPLOAD_HEADERS = ("EmployeeID", "Name", "Department", "Timestamp")

# Roster defaults.
DEFAULT_DEPARTMENT = "IT"
DEFAULT_FIRST_NAME = "New"
DEFAULT_LAST_NAME = "Employee"
DEFAULT_ROLE = "User"

# Punch labels.
UNAUTHORIZED = "Unauthorized Entry"
NOT_PROVIDED = "NOT PROVIDED"
UNKNOWN_ID = "UNKNOWN"

# Report A labels.
A_ONTIME = "ONTIME"
A_OVERTIME = "OVERTIME"
A_LATE_LATE = "LATE_ENTRY_AND_LATE_EXIT"
A_LATE_EARLY = "LATE_ENTRY_AND_EARLY_EXIT"
A_EARLY = "EARLY_DEPARTURE"
A_INCOMPLETE = "Incomplete Record"
A_CHART_STATUSES = (A_ONTIME, A_OVERTIME, A_LATE_LATE, A_LATE_EARLY, A_EARLY)
A_MISSING_CHECKOUT = "Missing Checkout"
A_NO_HOURS = "-"
A_DEFAULT_EMPTYPE = "Regular"

# Report B labels.
B_COMPLIANT = "Compliant"
B_OVERTIME = "Overtime"
B_LATE_EARLY = "Late & Early"
B_LATE = "Late Arrival"
B_EARLY = "Early Departure"
B_NOT_OUT = "Not Checked Out"
B_NOT_IN = "Not Checked In"
B_UNKNOWN_NAME = "Unknown Employee"
B_DEFAULT_DEPARTMENT = "Unassigned"
B_DEFAULT_EMPTYPE = "N/A"

# CSV report header.
REPORT_CSV_HEADER = (
    "Employee ID",
    "First Name",
    "Last Name",
    "Department",
    "Date",
    "Weekday",
    "First Check In",
    "Last Check Out",
    "Total Time",
    "Status",
)

# Dashboard colour bands (minute of day / hours), as (low, high, label).
IN_TIME_BANDS = ((420, 524, "primary"), (525, 550, "success"), (551, 585, "warning"), (586, None, "danger"))
OUT_TIME_BANDS = ((None, 1064, "danger"), (1065, 1079, "warning"), (1080, 1139, "success"), (1140, None, "primary"))
HOURS_BANDS = ((10.0, "info"), (9.0, "success"), (8.0, "warning"))  # else danger
STATUS_SEVERITY = {
    "ONTIME": "success",
    "EARLY_DEPARTURE": "warning",
    "LATE_ENTRY_AND_LATE_EXIT": "warning",
    "LATE_ENTRY_AND_EARLY_EXIT": "danger",
    "OVERTIME": "info",
}
EXPECTED_HOURS_PER_DAY = 9
COMPLIANCE_BANDS = ((75.0, "danger"), (90.0, "warning"))  # else success

# Timeline labels.
TIMELINE_IN = "First Check In"
TIMELINE_OUT = "Last Check Out"
TIMELINE_MISSING = "Missing checkout registration"

# Excel serial day of 1970-01-01, and the largest valid serial (9999-12-31).
EXCEL_EPOCH_SERIAL = 25569
EXCEL_MAX_SERIAL = 2958465


@dataclass(frozen=True)
class ShiftPolicy:
    """Thresholds of one report variant (minutes of day, hours)."""

    late_after_minute: int  # first-in minute-of-day strictly above this is late
    early_before_minute: int  # last-out minute-of-day strictly below this is early
    overtime_hours: float  # hours strictly above this is overtime
    single_punch_noon_hour: int = 13  # report B: single punch before this hour is a check-in
    labels: dict = field(default_factory=dict)


POLICY_A = ShiftPolicy(late_after_minute=550, early_before_minute=1080, overtime_hours=9.0)
POLICY_B = ShiftPolicy(late_after_minute=540, early_before_minute=1080, overtime_hours=9.0, single_punch_noon_hour=13)
