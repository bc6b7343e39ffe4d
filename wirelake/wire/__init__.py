"""Parsers of captured bytes: plain functions from bytes to records, used inside Arrow batches."""
