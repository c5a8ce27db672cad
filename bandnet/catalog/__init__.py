"""Every operator as a runnable query over the given tables, with its SQL check where there is one."""

from bandnet.catalog import linear, network, nnls, optimum, preparation, sparse, training  # noqa: F401
from bandnet.catalog.network import accuracy_of_formula_network
from bandnet.catalog.registry import CATALOG

flagship = accuracy_of_formula_network

__all__ = ["CATALOG", "flagship"]
