"""Part of citegrid: operators."""
