"""The plan that adaptive execution ended with, as text, and what it scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

INITIAL = "== Initial Plan =="


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def final_plan(df: DataFrame) -> str:
    """Executed plan of a frame that has run: the final trees, of subqueries too, without the initial ones."""
    out, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if skip is not None and _depth(line) >= skip:
            continue
        skip = None
        if INITIAL in line:
            skip = _depth(line)
            continue
        out.append(line)
    return "\n".join(out)


def scans(plan: str, table: str) -> int:
    """How often ``plan`` reads ``table``; what is reused counts once."""
    return sum("FileScan" in line and f"{table}.parquet" in line for line in plan.splitlines())
