"""Part of citegrid: sources."""
