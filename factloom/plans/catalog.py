"""All registered queries and oracles."""

import factloom.functions.embed
import factloom.operators.aliases
import factloom.operators.analytics
import factloom.operators.bridge
import factloom.operators.cluster
import factloom.operators.density
import factloom.operators.extract
import factloom.operators.indexing
import factloom.operators.langprofile
import factloom.operators.loading
import factloom.operators.quality
import factloom.operators.search
import factloom.operators.tables
import factloom.operators.text
import factloom.operators.units
import factloom.operators.walk
import factloom.streaming.jobs  # noqa: F401
from factloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
