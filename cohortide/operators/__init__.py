"""Building blocks, each a function from DataFrames to DataFrames."""
