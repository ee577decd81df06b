"""Entity resolution, snapshot comparison and proximity operators on Spark DataFrames."""
