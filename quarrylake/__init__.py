"""quarrylake: dataset-union search on Spark DataFrames."""
