"""functions of the mosaic engine."""
