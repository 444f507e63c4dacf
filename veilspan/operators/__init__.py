"""Span detection, merging, chunking, vault and egress operators on DataFrames."""
