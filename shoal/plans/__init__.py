"""Named queries: each module holds queries and, where SQL can say it, their SQL."""
