"""Readers and writers: page dumps, feature blocks, orders, manifests, probability traces."""
