"""Operators over point clouds: DataFrames with point_index BIGINT and x, y, z, mass FLOAT.

point_index stands for the order of a file, which rows of a DataFrame don't have."""
