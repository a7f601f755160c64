"""formlake operators."""
