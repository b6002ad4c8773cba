"""seqsys: containment networks, intervals, co-occurrence and data quality on Spark DataFrames."""
