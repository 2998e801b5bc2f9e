"""wordloom: labelled-text preparation, vectors, scoring and run analytics on Spark.

Operators take and return DataFrames.  The core work is expressed with built-in Spark
expressions, joins, aggregates and windows; Python workers appear only where matrices
are multiplied in bulk (recurrent scoring, blocked neighbour search).
"""

__version__ = "0.1.0"
