"""Intermediate models (M-1...M-6) and distributed building blocks."""
