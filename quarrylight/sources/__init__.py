"""Scans and sinks: exports, landed API responses, sessions, reports."""
