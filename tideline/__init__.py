"""tideline: an ordered key-value changelog engine expressed in Spark DataFrames."""

__version__ = "0.1.0"
