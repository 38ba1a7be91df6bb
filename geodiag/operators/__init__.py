"""Diagnostic operators: rules, distortion, score, comparison, repair, profile and explanations."""
