"""Operators for texts and models; nothing outside this subpackage imports it."""
