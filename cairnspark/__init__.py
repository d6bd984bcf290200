"""A Spark-first engine for grouping vector data: density-based, hierarchical and centroid-based, with their building blocks."""
