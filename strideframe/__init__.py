"""Spark jobs over tables of synchronized motion and brain recordings."""
