"""Operators for training-data pipelines.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where the folder is present. Ids are whole numbers, or null; columns of
other kinds must be castable to long.
"""
