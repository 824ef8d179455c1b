"""cargolake: logistics-operations analytics as plain Spark DataFrame / SQL /
Structured Streaming jobs.

Every operator takes DataFrames and returns a DataFrame.  Nothing is collected
to the driver; time-dependent operators take an explicit ``as_of``.
"""

from cargolake.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
