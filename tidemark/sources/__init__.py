"""Readers, file manifests and locators."""
