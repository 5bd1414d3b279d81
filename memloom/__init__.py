"""memloom: conversation-memory analytics on PySpark DataFrames."""
