"""Delivery envelopes and sinks."""
