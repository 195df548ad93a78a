"""Structured Streaming: arriving events and answers. The batch operators above stay the reference for results."""
