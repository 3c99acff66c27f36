"""A compressed radix trie over whole texts: equal texts end in one terminal, which holds what is known of them."""

from __future__ import annotations

from collections.abc import Iterator

FIRST_LOOK = 64


class Node:
    """An edge, the bytes text[start:end], and what follows it."""

    __slots__ = ("children", "end", "held", "start", "text")

    def __init__(self, text: bytes, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.children: dict[int, Node] = {}
        self.held = None


def shared_length(a: bytes, at: int, b: bytes, start: int, most: int) -> int:
    """How many of the next `most` bytes are equal: pieces that double until one differs, which is then halved until one byte is left."""
    low, step = 0, FIRST_LOOK
    while low < most and a[at + low : at + min(low + step, most)] == b[start + low : start + min(low + step, most)]:
        low, step = low + step, step * 2
    high = min(low + step, most)
    while low < high - 1:
        middle = (low + high) // 2
        if a[at + low : at + middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle
    return min(low, most) if low >= most or a[at + low] != b[start + low] else low + 1


class TextTrie:
    """Edges keep a whole text and two places in it, so splitting one copies nothing; work per text is linear in its length."""

    def __init__(self):
        self.root = Node(b"", 0, 0)

    def terminal(self, text: bytes) -> Node:
        """The node where the text ends, made if it is new; its `held` is None until the caller sets it."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node.children.get(text[at])
            if child is None:
                leaf = Node(text, at, n)
                node.children[text[at]] = leaf
                return leaf
            length = child.end - child.start
            same = shared_length(text, at, child.text, child.start, min(length, n - at))
            if same < length:
                middle = Node(child.text, child.start, child.start + same)
                child.start += same
                middle.children[child.text[child.start]] = child
                node.children[text[at]] = middle
                child = middle
            node, at = child, at + same
        return node

    def terminals(self) -> Iterator[Node]:
        """All nodes that hold something."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.held is not None:
                yield node
            stack.extend(node.children.values())
