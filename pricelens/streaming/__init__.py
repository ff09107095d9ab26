"""The batch operators on streams."""
