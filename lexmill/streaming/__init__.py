"""The map-like operators on streams, and deduplication within a watermark."""
