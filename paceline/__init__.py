"""Analytics over multi-camera tracking metadata, on Spark DataFrames."""
