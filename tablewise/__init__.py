"""tablewise: automated table analysis (profile, clean, EDA, chart data, model
comparison, attribution) expressed as Spark DataFrame operations.

Every operator takes and returns DataFrames; only bounded statistics
(bounds, modes, plan rows, model summaries) ever reach the driver.
"""

from tablewise.session import get_spark, checkpoint_dir, materialize

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
