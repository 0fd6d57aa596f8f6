"""Record-addressable compressed data as DataFrames."""
