"""functions of the station and raster library."""
