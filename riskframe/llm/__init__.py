"""Operators for preparing training data: each module holds one operator, ``queries`` names them all."""
