"""Code-graph analytics and corpus operators on PySpark.

Operators are functions from DataFrames to DataFrames; the plans package names
them as queries over a directory of Parquet tables.
"""

__version__ = "0.1.0"
