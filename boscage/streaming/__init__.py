"""Streams: trees kept up to date as files arrive, and windows over events."""
