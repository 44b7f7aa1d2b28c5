"""Evidence about code and its documentation, as DataFrames."""
