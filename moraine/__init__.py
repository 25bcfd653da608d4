"""Glacial-lake observation and outburst hazard scoring on Spark."""
