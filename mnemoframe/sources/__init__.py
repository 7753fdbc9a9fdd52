"""Readers and writers: record files, sessions, JSON lines, versioned tables."""
