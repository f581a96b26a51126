"""Transformations of the tables in tidefold.schemas."""
