"""Readers, replay sources and sinks."""
