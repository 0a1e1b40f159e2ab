"""State processors and streaming jobs."""
