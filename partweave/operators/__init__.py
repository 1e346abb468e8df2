"""Operators on parts lists: every one takes and returns DataFrames."""
