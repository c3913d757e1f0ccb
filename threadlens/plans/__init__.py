"""Named plans: the registered queries, their SQL twins, and end-to-end jobs."""
