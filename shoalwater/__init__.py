"""Environmental time series and forecast verification on Spark DataFrames."""
