"""Part of the policy engine: operators."""
