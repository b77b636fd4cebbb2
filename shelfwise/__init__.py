"""Retail price-intelligence analytics as PySpark DataFrame programs."""
