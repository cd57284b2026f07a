"""streaming of the mosaic engine."""
