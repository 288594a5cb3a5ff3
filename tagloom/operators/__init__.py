"""Table operators: DataFrames in, DataFrames out. Nothing here collects to the driver."""
