"""Operators over architecture tables: DataFrames in, a DataFrame out."""
