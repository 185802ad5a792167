"""Meta paths as text: parsing, inversion, names of what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

INVERSE = "^-1"


@dataclass(frozen=True)
class Step:
    """One edge type of a path, walked forwards or backwards."""

    edge: str
    inverse: bool = False

    def __str__(self) -> str:
        return self.edge + INVERSE * self.inverse


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: str
    target: str


def initials(edge: EdgeType) -> str:
    return edge.source[:1].upper() + edge.target[:1].upper()


def parse_path(path: str, edges: list[EdgeType], by: str = "edge_type") -> list[Step]:
    """``a#b^-1#c`` by edge type, or ``APV`` by upper-case initials of node types.

    Unknown names, broken chains and ambiguous initials are errors.
    """
    by_name = {e.name: e for e in edges}
    steps: list[Step] = []
    if by == "edge_type":
        for part in path.split("#"):
            name, inverse = (part[: -len(INVERSE)], True) if part.endswith(INVERSE) else (part, False)
            if name not in by_name:
                raise ValueError(f"unknown edge type {name!r} in path {path!r}")
            steps.append(Step(name, inverse))
    elif by == "initials":
        if len(path) < 2:
            raise ValueError(f"path {path!r} has no step")
        for a, b in zip(path, path[1:], strict=False):
            found = [Step(e.name) for e in edges if initials(e) == a + b]
            found += [Step(e.name, True) for e in edges if initials(e) == b + a and a != b]
            if len(found) != 1:
                raise ValueError(f"step {a + b!r} of path {path!r} fits {len(found)} edge types")
            steps += found
    else:
        raise ValueError("by is 'edge_type' or 'initials'")
    ends = [(e.target, e.source) if s.inverse else (e.source, e.target) for s in steps for e in [by_name[s.edge]]]
    for (_, left), (right, _) in zip(ends, ends[1:], strict=False):
        if left != right:
            raise ValueError(f"path {path!r} goes from {left!r} to {right!r} without an edge")
    return steps


def inverted(steps: list[Step]) -> list[Step]:
    return [Step(s.edge, not s.inverse) for s in reversed(steps)]


def inverse_name(name: str) -> str:
    """The name of the transposed matrix: parts in reverse order, each inverted; ``(...)^-1`` is unwrapped."""
    if name.startswith("(") and name.endswith(")" + INVERSE):
        return name[1 : -len(INVERSE) - 1]
    return "#".join(p[: -len(INVERSE)] if p.endswith(INVERSE) else p + INVERSE for p in reversed(name.split("#")))


def mirrored_name(name: str, by: str = "edge_type") -> str:
    """The name of the whole symmetric path of which *name* is the left half: ``APV`` gives ``APVPA``."""
    return name + name[-2::-1] if by == "initials" else f"{name}#({name}){INVERSE}"


def artefact_name(path: str, place_type: str, mode: str, eps_m: int, weighted: bool, resolution: int | None = None) -> str:
    """A readable key of a spatially extended matrix, for :class:`waymesh.plans.catalog.Catalog`."""
    if mode not in ("exact", "grid"):
        raise ValueError("mode is 'exact' or 'grid'")
    parts = [path, place_type, mode, "weighted" if weighted else "counted", f"{eps_m}m"]
    return "|".join(parts if resolution is None else [*parts, f"res{resolution}"])
