"""Where pages come from and where files go."""
