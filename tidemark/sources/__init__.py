"""Configurations, input tables and sinks."""
