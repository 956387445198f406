"""Graph operators on edge and vertex DataFrames."""
