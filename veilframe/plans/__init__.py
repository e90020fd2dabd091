"""Declarative inputs: detector packs, conditions, policy bundles; and the query catalogue."""
