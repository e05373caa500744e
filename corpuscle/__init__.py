"""Analytics over text and source-code corpora as Spark DataFrames."""
