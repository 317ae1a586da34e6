"""Structured Streaming: event filters, windows, last-state lookups and idempotent upserts."""
