"""formlake functions."""
