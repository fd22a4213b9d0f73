"""Histories of versioned sequences, as DataFrame computations."""
