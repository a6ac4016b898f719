"""vecframe: vector and metadata collections as Spark DataFrames."""
