"""quire: document analytics on Spark DataFrames."""

__version__ = "0.2.0"
