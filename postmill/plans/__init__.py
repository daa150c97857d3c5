"""The user-level jobs and queries."""
