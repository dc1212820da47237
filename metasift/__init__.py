"""Evidence-synthesis analytics on PySpark DataFrames."""
