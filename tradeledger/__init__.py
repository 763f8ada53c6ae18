"""Trade and inventory books on Spark DataFrames."""
