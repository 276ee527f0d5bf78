"""Part of gleanery."""
