"""Change batches and call statistics, as batch plans and on Structured Streaming."""
