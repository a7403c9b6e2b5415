"""Configuration and the engine that composes operators into queries."""
