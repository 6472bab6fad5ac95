"""Document-intelligence and retrieval operators as DataFrame to DataFrame functions."""
