"""Part of lexiweave: functions."""
