"""Set-oriented marine spill analytics on PySpark DataFrames."""
