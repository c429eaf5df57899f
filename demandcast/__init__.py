"""Retail demand forecasting as Spark DataFrame jobs."""
