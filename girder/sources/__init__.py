"""Part of the policy engine: sources."""
