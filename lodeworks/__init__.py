"""Lodeworks: mining and analytics on Spark DataFrames."""
