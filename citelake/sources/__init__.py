"""Readers and writers, and the adapter from star-schema tables to citation tables."""
