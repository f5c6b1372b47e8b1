"""A PySpark-native analytics engine for box-based furniture designs and their training data."""
