"""corpusloom: document indexing, search, ranking and corpus preparation on Spark DataFrames."""
