"""Table-to-table building blocks; every function takes and returns DataFrames."""
