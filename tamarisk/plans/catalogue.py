"""Registry of the library's own queries."""

from tamarisk.plans import drought, flood, food

QUERIES: dict = {**flood.QUERIES, **drought.QUERIES, **food.QUERIES}
ORACLE: dict = {**flood.ORACLE, **drought.ORACLE, **food.ORACLE}
