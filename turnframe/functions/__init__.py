"""Part of turnframe."""
