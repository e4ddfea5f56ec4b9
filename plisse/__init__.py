"""plisse: finds and folds repetition in chat payloads, logs and documents, on Spark DataFrames."""

__version__ = "0.1.0"
