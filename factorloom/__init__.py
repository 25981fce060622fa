"""factorloom: a Spark-native engine for quantitative factor research."""

__version__ = "0.1.0"
