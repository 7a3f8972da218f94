"""City-scale geospatial analytics expressed as Spark DataFrame transformations."""
