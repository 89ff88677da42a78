"""tessella: retrieval, knowledge-graph and text analytics on PySpark DataFrames."""
