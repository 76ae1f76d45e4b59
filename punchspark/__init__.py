"""Badge-punch attendance analytics expressed as Spark DataFrame plans.

Subpackages:
  functions  column expressions (trim/null rules, name cleaning, date parsing, time formats)
  sources    table scans, upload readers (CSV, workbooks), header aliasing, sinks
  operators  roster sync, identity resolution, ingestion, daily reports A and B, roll-ups
  plans      end-to-end compositions (dashboard, export, upload ingestion, driver-table mapping)
  streaming  file-stream ingestion of punch uploads
"""

from punchspark.policy import POLICY_A, POLICY_B, ShiftPolicy  # noqa: F401

__all__ = ["POLICY_A", "POLICY_B", "ShiftPolicy"]
