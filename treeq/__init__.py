"""Tree-pattern queries over forests held as Spark DataFrames."""
