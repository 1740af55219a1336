"""A Spark-native engine for partitioned ledger streams with exactly-once sinks."""

__version__ = "0.1.0"
