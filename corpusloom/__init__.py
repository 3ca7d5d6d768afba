"""corpusloom: corpus audit and analysis operators on Spark SQL and DataFrames."""
