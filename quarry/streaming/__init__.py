"""Streaming: intentionally empty.

The benchmark being rebuilt has no streaming, watermark, windowed-stream or
stateful operator; every job here is batch. Nothing is added for the sake of
the category.
"""
