"""Part of citegrid: streaming."""
