"""Column functions: text preparation, checksums, masks, scrubbing."""
