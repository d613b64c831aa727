"""Geospatial analytics and catalog operators on Spark."""
