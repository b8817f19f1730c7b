"""Knowledge-freshness analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing runs until the
caller acts on the result.
"""
