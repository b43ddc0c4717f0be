"""Streaming.

The reference study has no streaming (no watermark, window, state or
late-data code), so nothing here is a reference operator.  Scoring with a
fitted model (``operators.boost.score.predict``) is a stateless
``mapInPandas`` and therefore works unchanged on a streaming DataFrame.
"""
