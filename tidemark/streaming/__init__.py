"""Streaming forms: replay and TTL state kept between micro-batches."""
