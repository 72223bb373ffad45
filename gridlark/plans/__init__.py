"""Analyses described as JSON, and operators that users register for them."""
