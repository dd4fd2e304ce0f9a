"""Point-in-time operators on DataFrames."""
