"""Training-data pipeline operators; each module is one operator, ``catalog`` registers their queries."""
