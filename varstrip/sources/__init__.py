"""Readers and writers: venue frames, historical files, table sinks, message rows."""
