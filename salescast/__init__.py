"""salescast: daily sales analytics and forecasting as Spark DataFrame operators.

Every operator takes and returns DataFrames in the canonical long form
``(series STRING, datum DATE, value DOUBLE)`` (plus operator-specific
columns).  Nothing is collected to the driver; the optimizer sees one plan.
"""

from salescast.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
