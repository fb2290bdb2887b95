"""trailmark: journey and transition analytics as Spark DataFrame operators.

Every operator is a pure ``DataFrame -> DataFrame`` function built from Spark
SQL expressions, joins, aggregates and windows (MLlib for the learned parts).
"""

__version__ = "0.1.0"
