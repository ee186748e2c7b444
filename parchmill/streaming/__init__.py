"""Stateful parts as Structured Streaming queries; each has a batch form that gives the same rows."""
