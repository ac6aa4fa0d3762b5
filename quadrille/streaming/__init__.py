"""Streams: sessions and arrivals from files as they come."""
