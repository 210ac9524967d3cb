"""The call algebra above Catalyst: what calls a plan implies, what they cost, and rewrites that need fewer."""
