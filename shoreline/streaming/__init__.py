"""Incremental intake of action reports.

The reference reads each report once; nothing in it is a stream.  The only
streaming piece here is the stateless cleaning step (recode + exclude)
applied to report files as they arrive in a folder, so newly published
reports are appended to a cleaned table without re-reading old ones.
"""

from shoreline.streaming.intake import clean_actions_stream

__all__ = ["clean_actions_stream"]
