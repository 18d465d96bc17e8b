"""Field-service KPIs as Spark DataFrames.

Nested JSON exports -> typed tables -> keyed upserts -> year-to-date KPIs.
"""
