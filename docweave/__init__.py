"""Document-structure reconstruction and corpus preparation as DataFrame transforms."""
