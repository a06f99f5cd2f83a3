"""Readers, corpus routing, rules and sinks."""
