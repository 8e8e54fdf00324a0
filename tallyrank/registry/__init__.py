"""All registered queries, and their SQL where SQL can say it."""

from tallyrank.registry import certificates, models, quality, ranking, scoring, streams  # noqa: F401
from tallyrank.registry.base import ORACLES, QUERIES  # noqa: F401
