"""A Spark-native raster analytics engine."""
