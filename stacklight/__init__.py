"""Catalogue analytics and recommendation on Spark."""
