"""Analytics on spatial fields, as DataFrames."""
