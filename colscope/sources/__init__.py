"""Readers, upload checks, derived views and sinks."""
