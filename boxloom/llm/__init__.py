"""Training-data operators over document, conversation and benchmark tables."""
