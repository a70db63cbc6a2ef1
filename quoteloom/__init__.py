"""Evidence-backed coding of document collections as DataFrame and Structured Streaming jobs."""
