"""corpusmill: corpus analytics expressed as Spark DataFrames."""
