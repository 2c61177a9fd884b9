"""DataFrame operators: lazy, composable with df.transform, keyed by series or path."""
