"""Extensions for edges that arrive as a stream (the batch operators have no counterpart here)."""
