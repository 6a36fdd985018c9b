"""newsloom: news and signal analytics as ordinary Spark DataFrame queries."""
