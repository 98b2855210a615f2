"""Where data lives: versioned collections and the object store."""
