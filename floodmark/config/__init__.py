"""Feeds, datasets and rules as YAML declares them."""
