"""Incremental counting of newly landed reads with Structured Streaming."""
