"""Declared dataframe transformations, run as a graph on Spark."""

from .config import config_context, get_config
from .functions.types import Binary, Boolean, Byte, Date, DateFormat, DateTime, Decimal, Double, Float, Integer, Long, Short, String, Unknown
from .operators.cache import Cache, CacheMode
from .operators.merge import Ledger, MergeCache, ParquetCache, TableCache
from .plans.node import Edge, Node, NodeFunction, PreprocessMode, node, node_function
from .plans.schema import Cardinality, Column, Schema

__all__ = [
    "Binary", "Boolean", "Byte", "Cache", "CacheMode", "Cardinality", "Column", "Date", "DateFormat", "DateTime", "Decimal", "Double", "Edge", "Float",
    "Integer", "Ledger", "Long", "MergeCache", "Node", "NodeFunction", "ParquetCache", "PreprocessMode", "Schema", "Short", "String", "TableCache", "Unknown",
    "config_context", "get_config", "node", "node_function",
]
