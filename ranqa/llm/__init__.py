"""Operators for preparing training data at scale, each over plain DataFrames."""
