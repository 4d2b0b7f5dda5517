"""Text formats in and out; everything else works on DataFrames."""
