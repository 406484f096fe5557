"""Tamarisk: hazard, season and food-security analytics as Spark DataFrame programs."""
