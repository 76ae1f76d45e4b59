"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_LIMIT = 10 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimate unavailable (e.g. remote session)
        return None


def broadcast_limit(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", str(DEFAULT_BROADCAST_LIMIT))
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", str(raw).strip().lower()).groups()
    return max(0, int(number) << (10 * " kmgtp".index(unit or " ")))


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """True when Catalyst's size estimate of ``df`` is within the broadcast limit."""
    limit = broadcast_limit(df) if limit is None else limit
    size = estimated_bytes(df)
    return size is not None and 0 < limit and size <= limit


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only when the estimated size is within ``limit``.

    Beyond it the join stays a shuffle join (and AQE may still switch to a
    broadcast at run time from real shuffle sizes).
    """
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir`` (lineage cut, survives
    executor loss). Persisted first, so writing the checkpoint reads the cached blocks
    instead of recomputing the plan."""
    from punchspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    done = kept.checkpoint(eager=True)
    kept.unpersist()
    return done


def measured(df: DataFrame, max_rows: int = 2_000_000) -> tuple[DataFrame, int, bool]:
    """Checkpoint a derived table and count it: (table, rows, fits_broadcast).

    Derived tables (e.g. distinct names) have no useful size estimate before they
    run. The checkpoint (shared ``spark.checkpoint.dir``) cuts lineage, the count
    is then cheap, and ``fits_broadcast`` uses the measured rows × a per-row width
    bound from the schema. Tables derived 1:1 from it inherit the bound.
    """
    done = checkpointed(df)
    rows = done.count()
    width = 16 + sum(64 if f.dataType.typeName() in ("string", "binary") else 16 for f in done.schema.fields)
    limit = broadcast_limit(done)
    return done, rows, rows <= max_rows and limit > 0 and rows * width <= limit
