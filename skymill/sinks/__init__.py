"""Image and table sinks."""
