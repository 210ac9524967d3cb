"""sqlume: a semantic SQL dialect and data-preparation operators on Spark DataFrames."""
