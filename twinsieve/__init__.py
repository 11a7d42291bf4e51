"""Near-duplicate detection, grouping, scoring and curation on Spark DataFrames."""

__version__ = "0.1.0"
