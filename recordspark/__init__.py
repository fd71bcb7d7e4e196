"""recordspark: a PySpark-native analytics engine for large record archives."""
