"""DataFrame jobs: filters, page extraction, matching, rules, sessions, reports, quality."""
