"""seqforge: sparse linear models over labelled symbol sequences, as Spark DataFrames."""
