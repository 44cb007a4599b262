"""Gneiss: a Spark-native engine for curating layered, self-describing records."""
