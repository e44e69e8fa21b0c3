"""judgefuse: DataFrame operators for auditing automated pass/fail verdicts at scale.

Every public operator takes DataFrames and returns a lazy DataFrame built from
built-in Spark expressions, joins, windows and aggregations.
"""

__version__ = "0.1.0"
