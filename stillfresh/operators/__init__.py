"""DataFrame operators: history, decisions, table building, evidence, audits."""
