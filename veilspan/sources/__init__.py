"""Table readers, policy readers, generators and sinks."""
