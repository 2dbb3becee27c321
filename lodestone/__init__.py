"""Property-graph analytics on PySpark: build, query, grade and fold, as DataFrame programs."""
