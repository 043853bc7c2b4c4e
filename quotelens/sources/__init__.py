"""Readers: manifests, results, value maps, adapters, stage policies, run folders, state."""
