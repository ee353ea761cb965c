"""Query trees."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Phrase:
    """Index tokens that stand one after the other in one field; the last may be a prefix.

    No tokens (``"%"``) match nothing; the parser leaves them out beside other words.
    """

    tokens: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    """What matches ``left`` and not ``right``."""

    left: Node
    right: Node


Node = Phrase | And | Or | Not


def simplified(node: Node) -> Node | None:
    """Without the phrases that have no tokens, which match nothing; None where nothing can match."""
    if isinstance(node, Phrase):
        return node if node.tokens else None
    left, right = simplified(node.left), simplified(node.right)
    if isinstance(node, And):
        return None if left is None or right is None else And(left, right)
    if isinstance(node, Not):
        return left if left is None or right is None else Not(left, right)
    if left is None or right is None:
        return right if left is None else left
    return Or(left, right)


def phrases(node: Node | None) -> list[Phrase]:
    """In order, repeated ones repeatedly."""
    if node is None:
        return []
    return [node] if isinstance(node, Phrase) else phrases(node.left) + phrases(node.right)
