"""Property-graph analytics and data-pipeline operators on PySpark DataFrames."""
