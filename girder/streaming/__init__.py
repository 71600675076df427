"""Part of the policy engine: streaming."""
