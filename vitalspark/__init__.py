"""Pulse-signal analytics on Spark."""
