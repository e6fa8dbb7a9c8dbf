"""Preparation and analysis of large self-reported pay surveys, written as Spark DataFrame jobs."""
