"""Weftline: select-project-join analytics and corpus preparation on PySpark."""
