"""codeseam: a Spark-native engine to index, search and prepare corpora of code and text."""

__version__ = "0.1.0"
