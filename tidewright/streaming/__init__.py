"""Streams: windowed counts with late rows, diagnostics appended batch by batch, steps that resume."""
