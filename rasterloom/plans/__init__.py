"""Tap tables and the registered queries."""
