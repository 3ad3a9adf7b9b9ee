"""Readers: archives, log lines, binary traces and tables."""
