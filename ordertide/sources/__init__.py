"""Batch and streaming sources of order events, and the province dimension."""
