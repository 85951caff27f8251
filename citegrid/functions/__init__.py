"""Part of citegrid: functions."""
