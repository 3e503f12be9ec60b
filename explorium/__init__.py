"""A PySpark-native engine for exploratory modelling."""
