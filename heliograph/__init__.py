"""heliograph: a Spark-native engine for web-archive capture indexes.

Captures are rows ``(surt, ts, json)``.  Every operator is a function from
DataFrames to DataFrames that leaves physical planning to Catalyst; Python is
used, in Arrow batches, only where a grammar or a file format needs it.
"""

__version__ = "0.1.0"
