"""docloom: a PySpark-native engine for technical document collections."""
