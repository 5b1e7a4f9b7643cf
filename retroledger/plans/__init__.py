"""Compensation plans: operations, digests, files, configuration."""
