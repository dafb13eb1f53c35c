"""Marts, findings, data-quality checks, experiment analysis, extracts and the build."""
