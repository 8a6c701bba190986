"""Training-data operators: corpus jobs built on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
