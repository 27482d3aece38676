"""nightjar: a Spark-native engine for tables of wearable sleep nights."""

__version__ = "0.1.0"
