"""All registered queries: importing the modules registers them."""

from alertlake.plans import archive_queries, message_queries, queries, route_queries, stream_queries  # noqa: F401
from alertlake.plans.registry import ORACLE, QUERIES  # noqa: F401
