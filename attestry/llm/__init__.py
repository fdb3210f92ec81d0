"""Training-corpus operators. Nothing outside this subpackage imports it."""
