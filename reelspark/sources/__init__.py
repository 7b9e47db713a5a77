"""Where catalogue rows come from and are kept."""
