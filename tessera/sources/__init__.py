"""sources of the mosaic engine."""
