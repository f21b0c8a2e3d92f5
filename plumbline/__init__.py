"""Image-to-stroke analytics on Spark."""
