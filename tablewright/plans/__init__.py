"""Pipelines, models and the jobs made of them."""
