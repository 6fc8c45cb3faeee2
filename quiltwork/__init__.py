"""quiltwork: a Spark-native engine for territory analytics and training-data pipelines."""

__version__ = "0.1.0"
