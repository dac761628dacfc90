"""A PySpark-native analytics engine: container files and training corpora as relational datasets."""
