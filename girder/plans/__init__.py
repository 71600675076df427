"""Part of the policy engine: plans."""
