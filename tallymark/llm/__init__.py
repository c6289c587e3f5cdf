"""Training-data operators: tokens, languages, links, secrets, personal data,
duplicates, benchmark overlap and web archives. Nothing outside imports this
subpackage."""
