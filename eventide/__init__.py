"""Event-time operators over Spark DataFrames."""
