"""skein: a Spark-native engine for incremental analysis of source-code corpora."""

__version__ = "0.1.0"
