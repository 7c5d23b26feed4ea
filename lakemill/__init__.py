"""Lakemill: retail analytics and corpus preparation on PySpark DataFrames."""
