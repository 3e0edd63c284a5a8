"""PySpark-native analytics over question banks and text corpora."""
