"""Spark-native analytics for white-beam X-ray diffraction: indexing as relational dataflow."""
