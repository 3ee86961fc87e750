"""Session set-up, lineage cuts and size-checked joins."""
