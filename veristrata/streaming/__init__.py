"""Scans of streams: dependencies as they arrive, against feeds as they stand."""
