"""Cohort and time-to-event analytics over OMOP-style clinical tables, on Spark.

Every operator is a function from DataFrames to DataFrames.  ``sources`` reads and
writes tables, ``operators`` holds the building blocks, ``plans`` declares cohorts
and strings the blocks together into a study.
"""

__version__ = "0.1.0"
