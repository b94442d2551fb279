"""Documents around the operators: receipts, chains, history, steps."""
