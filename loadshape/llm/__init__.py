"""Operators of a training-data pipeline over document tables.

Every operator takes a DataFrame plus the names of its id and text columns and
reads only those two, so extra columns (also ones that share a name with an
output column) never matter. Nothing else in the library imports this package.
"""
