"""formlake streaming."""
