"""Tables, text files and vectors: what queries read and write."""
