"""Assembly as a stream, an addition of this engine."""
