"""cleanlake: data preparation and quality operators for Spark DataFrames."""
