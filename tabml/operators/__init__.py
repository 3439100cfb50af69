"""One module per family of operators; every function takes and returns DataFrames."""
