"""Linear infrastructure measured in aerial imagery, as Spark DataFrames."""
