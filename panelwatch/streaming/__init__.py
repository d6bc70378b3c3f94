"""Polled feeds as a stream."""
