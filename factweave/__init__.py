"""factweave: a PySpark-native engine for evidence-grounded facts.

Facts, relations, filings and documents are plain DataFrames over Parquet. Operators are functions from
DataFrame to DataFrame; nothing here holds state outside Spark.
"""

__version__ = "0.1.0"
