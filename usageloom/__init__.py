"""Spark-native analytics over coding-agent usage records.

Every public function takes DataFrames (plus explicit time zone, as-of instant
and thresholds) and returns a lazily evaluated DataFrame.
"""

__version__ = "0.1.0"
