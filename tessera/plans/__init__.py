"""plans of the mosaic engine."""
