"""Text operators for language-model corpora; nothing outside this package imports it."""
