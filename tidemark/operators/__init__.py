"""Transforms that run on batches and, unless they say otherwise, on streams."""
