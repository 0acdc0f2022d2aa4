"""Errors of the engine; all are ValueErrors."""


class GraphError(ValueError):
    """Base of all."""


class VertexNotFoundError(GraphError):
    """A root, target or edge endpoint is no vertex of the graph."""


class NegativeWeightError(GraphError):
    """A reached edge has a negative weight where none is allowed."""


class NegativeCycleError(GraphError):
    """A cycle of negative weight."""


class NegativeCapacityError(GraphError):
    """A negative or undefined capacity."""


class NoPathFoundError(GraphError):
    """No path joins source and target."""


class NonAcyclicGraphError(GraphError):
    """A cycle where none is allowed."""


class NonStronglyConnectedGraphError(GraphError):
    """Declared for callers; no operator raises it."""


class ParallelEdgeNotAllowedError(GraphError):
    """Declared for callers; parallel edges are dropped, not refused."""


class GraphTooLargeError(GraphError):
    """A graph is beyond the bound of a kernel that works on one graph in one task."""


class FormatError(GraphError):
    """A graph document is malformed."""
