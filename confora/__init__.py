"""confora: conformational-ensemble and relational analytics on PySpark."""
