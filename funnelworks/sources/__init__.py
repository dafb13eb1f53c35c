"""Scans, declared schemas, fixture adapters and sinks."""
