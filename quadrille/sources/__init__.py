"""Where positions and tables come from."""
