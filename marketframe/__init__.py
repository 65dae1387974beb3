"""Market time-series features and news sentiment on PySpark DataFrames."""
