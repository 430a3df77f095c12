"""Document-image and recognition-result analytics as Spark table work."""
