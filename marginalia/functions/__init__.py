"""Column functions: text measures, identities, query policies."""
