"""Scans and sinks of snapshots, logs and text fixtures."""
