"""Where rows come from: batch files of nodes, and the ledger's turns as seen in an events table."""
