"""Plans that take several rounds."""
