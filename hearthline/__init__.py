"""County-by-year hazard and household-cost analytics on Spark DataFrames."""

__version__ = "0.1.0"
