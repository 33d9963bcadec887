"""barrow: a PySpark-native analytics engine for document archives and the places they describe."""
