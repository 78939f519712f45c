"""Gridded zonal statistics on Spark."""
