"""strata: hierarchical social-graph analytics on PySpark DataFrames."""
