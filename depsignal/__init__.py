"""Repository-health analytics for software dependencies, on Spark DataFrames."""

__version__ = "0.1.0"
