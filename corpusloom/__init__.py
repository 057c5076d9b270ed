"""corpusloom: a Spark-native engine for corpora - chunking, retrieval, fusion, evaluation, history."""

__version__ = "0.1.0"
