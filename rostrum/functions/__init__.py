"""Part of the rostrum package."""
