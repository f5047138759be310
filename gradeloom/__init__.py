"""gradeloom: building and grading executable-task datasets with Spark DataFrames."""
