"""Readers: files, frames, event exports, metric scrapes, agent messages."""
