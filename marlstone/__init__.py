"""Analytics and training-data operators expressed with the PySpark DataFrame and SQL APIs."""
