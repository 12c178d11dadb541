"""Listing analytics and corpus preparation on Spark."""
