"""The three jobs: recommend, evaluate, train."""
