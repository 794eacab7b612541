"""Spark jobs that turn survey tables and public inventories into matched, feature-rich,
leakage-safe and honestly evaluated tables."""
