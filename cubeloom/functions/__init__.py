"""Terms and vocabulary."""
