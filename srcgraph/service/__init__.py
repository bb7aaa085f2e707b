"""What a user of a long-lived session has beside queries: jobs, settings and contexts."""
