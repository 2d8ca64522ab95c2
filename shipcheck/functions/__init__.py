"""Part of shipcheck."""
