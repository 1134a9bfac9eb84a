"""Customer-feedback analytics as lazy Spark DataFrame transformations."""
