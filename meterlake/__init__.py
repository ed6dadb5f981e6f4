"""Usage metering on Spark: log ingestion, quota meters and usage reports as DataFrames."""

from meterlake.session import configure

__all__ = ["configure"]
