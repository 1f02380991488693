"""A wide-column cell table, its log and its control plane as Spark DataFrames."""
