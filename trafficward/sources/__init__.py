"""Readers, samplers and writers of traffic logs."""
