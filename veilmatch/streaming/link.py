"""Tokenising and linking streams.

Tokenising keeps no state, so a session works on a streaming table as it is.
A stream is linked to a stored table by a stateless stream-static join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.link import link_equal, link_similar
from ..plans.session import Session


def link_stream_equal(session: Session, stream: DataFrame, stored_tokens: DataFrame, how: str = "inner", **options) -> DataFrame:
    """Streaming records joined to stored records of equal tokens."""
    if not stream.isStreaming:
        raise ValueError("the left side must be a stream")
    return link_equal(session.deterministic(stream, **options), stored_tokens, how)


def link_stream_similar(session: Session, stream: DataFrame, stored: DataFrame, threshold: float, block: str) -> DataFrame:
    """Matches of a stream of comparable tokens with a stored table, by blocking key."""
    if not stream.isStreaming:
        raise ValueError("the left side must be a stream")
    return link_similar(stream, stored, session.field_set, threshold, block=block, method="join")
