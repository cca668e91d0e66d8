"""docflow: a Spark-native content-processing engine (bytes -> artifacts -> chunks -> embedded records)."""

__version__ = "0.1.0"
