"""Driftline: change-data analytics on Spark DataFrames.

Ordered row changes and table snapshots are DataFrames; operators match,
filter, route, replay, denormalise, encode and verify them.  See README.md.
"""

__version__ = "0.1.0"
