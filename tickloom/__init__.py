"""Spark-native market screening and factor research over instrument-by-date tables."""
