"""Trade-panel elasticity estimation on Spark DataFrames."""
