"""Text normalization and text data processing on Spark DataFrames."""
