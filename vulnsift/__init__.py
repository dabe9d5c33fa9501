"""vulnsift: Spark-native search and feature preparation for security-advisory text.

Every public function takes and returns DataFrames (or Column expressions); nothing
collects data to the driver except size-checked side inputs, which say so.
"""

__all__ = ["session"]
