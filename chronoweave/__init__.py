"""Bitemporal facts, retrieval, receipts and provenance as set-based Spark jobs."""
