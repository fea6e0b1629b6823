"""freshet - river-runoff forecasting analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame.  Nothing is collected
on the driver; Catalyst plans all joins, windows and aggregates.
"""

__version__ = "0.1.0"
