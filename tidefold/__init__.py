"""Tidefold: replicated file histories as DataFrames — folding, version graphs, merging, capture and retention."""
