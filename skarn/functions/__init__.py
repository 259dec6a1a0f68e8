"""Part of the skarn engine."""
