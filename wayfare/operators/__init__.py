"""DataFrame-to-DataFrame operators; all lazy, none collects."""
