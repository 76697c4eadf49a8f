"""Operators for preparing training text: filtering, de-duplication, mixing and token output."""
