"""The dashboard bundle — records, chart statuses, trend and distribution from one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from punchspark import policy as P
from punchspark.operators import report_a as A
from punchspark.operators import rollups as D


@dataclass
class Dashboard:
    records: DataFrame  # classified and status-filtered records (cached once)
    statuses: tuple[str, ...]
    trend: DataFrame
    distribution: DataFrame
    summary: DataFrame
    employees: DataFrame

    def release(self) -> None:
        self.records.unpersist()


def dashboard_bundle(
    punches: DataFrame,
    users: DataFrame,
    departments: DataFrame,
    start=None,
    end=None,
    department_id=None,
    employee: str | None = None,
    status: str | None = None,
    keep: bool = True,
    raw_like: bool = False,
) -> Dashboard:
    """Compute the records once (persisted, spill-capable) and derive every chart from them.
    Without ``keep`` nothing is cached: for one query over several charts, which then share exchanges.

    The records are one row per employee-day, i.e. already aggregated, so
    persisting them is bounded by days × employees, not by punches.
    """
    records = A.daily_attendance(punches, users, departments, start, end, department_id, employee, status, raw_like=raw_like)
    if keep:
        records = records.persist(StorageLevel.MEMORY_AND_DISK)
    return Dashboard(
        records=records,
        statuses=P.A_CHART_STATUSES,
        trend=A.daily_trend(records),
        distribution=A.status_distribution(records),
        summary=D.summary_widgets(records),
        employees=D.employee_summary(records),
    )
