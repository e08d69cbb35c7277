"""Named queries over the driver tables, and the same rows as SQL for another engine."""
