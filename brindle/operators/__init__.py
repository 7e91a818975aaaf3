"""Operators over message tables: detectors, scores, actions, history, lookups, cases."""
