"""One module per area; each operator is a function of DataFrames."""
