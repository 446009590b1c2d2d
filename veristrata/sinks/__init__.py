"""Reports of findings and statements."""
