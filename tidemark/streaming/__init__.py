"""The guard on streams."""
