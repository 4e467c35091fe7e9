"""seqrank: rank likely targets of RNA-binding proteins with Spark DataFrames."""
