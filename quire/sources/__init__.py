"""sources of the layout engine."""
