"""Text analytics over a corpus as composable DataFrame plans."""
