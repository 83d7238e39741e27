"""Operators over sample rows."""
