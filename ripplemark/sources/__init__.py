"""Readers: the driver's tables and binary containers."""
