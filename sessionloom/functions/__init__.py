"""Part of sessionloom."""
