"""The ledger as a stream."""
