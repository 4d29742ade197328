"""keelson: Spark-native training-data preparation and analysis.

Operators take DataFrames and return DataFrames (``keelson.operators``); column expressions live
in ``keelson.functions``; day-partitioned sources and Parquet sinks in ``keelson.sources``;
stateless streaming helpers in ``keelson.streaming``; derived input views and the registry of
named, oracle-checked queries in ``keelson.plans``. ``keelson.session`` holds the session and
shared-folder helpers.
"""

__version__ = "0.1.0"
