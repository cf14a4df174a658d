"""Lodestrata: a PySpark-native analytics engine for claim-centred corpora.

Every operator is a function that takes and returns Spark DataFrames.
"""

__version__ = "0.1.0"
