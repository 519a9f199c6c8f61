"""DataFrame-level operators: profile, flags, relations, rules, fixes."""
