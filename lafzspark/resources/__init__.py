"""Linguistic tables. Everything in these modules is data."""
