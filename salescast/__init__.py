"""Seven-day sales forecasting over many series at once, on Spark DataFrames."""
