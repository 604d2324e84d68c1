"""graphloom: page evidence to a reviewable, typed concept graph, on Spark DataFrames."""
