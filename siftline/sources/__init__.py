"""Landed feed payloads in, raw listing records out, and the output sinks."""
