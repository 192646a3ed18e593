"""Part of tallyframe."""
