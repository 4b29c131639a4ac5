"""Structured Streaming forms of the monitoring and routing operators."""
