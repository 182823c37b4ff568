"""Point-in-time cross-sectional research on Spark DataFrames."""
