"""Structured Streaming forms of the rolling features."""
