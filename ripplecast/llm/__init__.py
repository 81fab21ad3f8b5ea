"""Operations of a large training-data pipeline, each a function from DataFrames to DataFrames."""
