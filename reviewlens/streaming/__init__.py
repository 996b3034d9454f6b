"""Stateless streaming scoring with stored models."""
