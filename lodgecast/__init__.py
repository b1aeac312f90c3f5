"""Rental-listing price analytics and regression, written as Spark jobs."""
