"""Plans that put operators together: test-table mappings and curate-and-publish."""
