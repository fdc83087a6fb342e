"""Configurations, artifacts and the jobs built of them."""
