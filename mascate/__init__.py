"""Sales-report operators for direct-sales data, written for PySpark.

Every operator is a lazy function from DataFrames and an explicit ``as_of`` date to a DataFrame.
"""
