"""Named queries over whole tables."""
