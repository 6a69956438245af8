"""A PySpark-native engine for typed property graphs of software projects."""
