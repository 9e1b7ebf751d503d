"""Rule text, rule tables and shared-folder tables."""
