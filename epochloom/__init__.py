"""epochloom: a PySpark-native engine for event epochs and shared patterns."""
