"""Where the rows come from and where they go."""
