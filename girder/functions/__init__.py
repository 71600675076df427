"""Part of the policy engine: functions."""
