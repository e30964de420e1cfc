"""Source extraction in gridded data, and the catalogue algebra around it, as Spark DataFrames."""
