"""Catalogue entity resolution on Spark."""
