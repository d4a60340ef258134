"""cartlens: session-recommendation analytics as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark's own expressions, joins, aggregates and windows.  The caller owns
the ``SparkSession``; nothing here holds a session or a path.
"""

__version__ = "0.1.0"
