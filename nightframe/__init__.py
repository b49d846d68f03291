"""Sleep-epoch analytics as plain PySpark DataFrame operators."""
