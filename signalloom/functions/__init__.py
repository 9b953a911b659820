"""Part of signalloom."""
