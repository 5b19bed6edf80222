"""Readers, sinks and carrier views."""
