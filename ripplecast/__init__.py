"""Change-impact analytics and corpus preparation as PySpark DataFrame operators."""
