"""A PySpark-native engine that curates fixed pools of training records by recipes."""
