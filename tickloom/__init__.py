"""tickloom: ordered bar and event analytics on PySpark DataFrames."""
