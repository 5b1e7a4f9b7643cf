"""Transaction assembly over streams."""
