"""lexispark: lexical retrieval and text classification over document tables, on Spark."""

__version__ = "0.1.0"
