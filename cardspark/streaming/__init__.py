"""Model maintenance over streams."""
