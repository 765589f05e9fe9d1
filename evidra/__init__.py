"""evidra: quality-evidence analytics and data preparation on Spark DataFrames."""
