"""motifmill: tandem-repeat analytics and sequence data processing on Spark DataFrames."""
