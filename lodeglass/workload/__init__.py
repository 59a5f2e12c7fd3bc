"""The registered queries: importing the package fills the registry."""

from lodeglass.workload import analyses, models, tables, texts  # noqa: F401
from lodeglass.workload.registry import ORACLE, QUERIES  # noqa: F401
