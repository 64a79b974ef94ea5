"""Jobs as streams."""
