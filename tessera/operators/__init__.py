"""operators of the mosaic engine."""
