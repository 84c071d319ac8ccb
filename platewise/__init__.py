"""Dish-discovery analytics on Spark."""
