"""Column-level building blocks: patterns, time layouts, severities, field paths."""
