"""formlake sources."""
