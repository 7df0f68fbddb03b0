"""Scoring of streams with fitted models."""
