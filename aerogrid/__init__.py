"""Station, raster and space-time feature analytics as Spark DataFrame operators."""
