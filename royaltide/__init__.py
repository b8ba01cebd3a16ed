"""Rights-and-royalties analytics as Spark jobs."""
