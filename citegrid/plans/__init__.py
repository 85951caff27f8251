"""Part of citegrid: plans."""
