"""asofly: temporal evidence analytics on PySpark DataFrames."""
