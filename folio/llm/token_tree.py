"""Operator 8: edit-aware token counting over segment trees of pre-tokens.

A text is cut into pre-tokens, about LEAF of which make a leaf; a balanced tree over the leaves holds the sums of
characters, pre-tokens and tokens. The pattern that cuts pre-tokens looks at nothing before its start and at no more than
two characters behind its match. So an edit needs only the leaves that it touches, from the last leaf boundary that is at
least that context before it, up to the first old leaf boundary that is again one of the new text. The tree is split
around these leaves and joined again with the new ones, however many they are, which makes a number of nodes anew that
grows with the height of the tree; all other nodes and sums stay. Leaves that become small are united with a neighbour
without being encoded.

Trees are kept as tables of leaf texts and sums (built), which edits take and return (edited), so a document is encoded
once and later only where it changes. Tokens of a pre-token are memoised per worker in a table of fixed size.

Null texts count as empty (a tree without leaves, no tokens), null edit lists and null edits as none; an edit's bounds
are clipped to the text, and edits apply one after the other. Repeated rows are trees each; null ids are kept. Only the
id and the text are read, whatever the names of other columns. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, positional, slabs, texts_of

#: Pre-tokens in a new leaf (half to twice as many after edits), characters that a match may look at behind its end, entries of a worker's memo table.
LEAF, CONTEXT, MEMO = 32, 2, 600_000


#: (height, leaves, characters, pre-tokens, tokens, left or text, right or None).
Node = tuple


def leaf(text: str, pieces: int, tokens: int) -> Node:
    return (0, 1, len(text), pieces, tokens, text, None)


class Counter:
    """Pre-tokens and token counts of one vocabulary of ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.cut = regex.compile(pattern).findall
        self.memo: dict[str, int] = {}

    def count(self, pieces: list[str]) -> int:
        total, get = 0, self.memo.get
        for p in pieces:
            n = get(p)
            if n is None:
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= 64:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[p] = n
            total += n
        return total

    def leaves(self, pieces: list[str]) -> list[Node]:
        """Leaves of about LEAF pre-tokens, of nearly equal numbers."""
        k = max(1, round(len(pieces) / LEAF)) if pieces else 0
        at = [i * len(pieces) // k for i in range(k + 1)] if k else [0]
        return [leaf("".join(part := pieces[a:b]), len(part), self.count(part)) for a, b in zip(at, at[1:], strict=False)]


_counters: dict[str, Counter] = {}


def counter_for(ranks: bytes, pattern: str) -> Counter:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(ranks, pattern)
    return _counters[key]


class TokenTree:
    """A balanced tree over the leaves of one document; every node holds the sums of the leaves below it.

    touched counts the nodes that edits have made, reencoded the characters that they have encoded again.
    """

    def __init__(self, counter: Counter, leaves: list[Node]):
        self.counter, self.touched, self.reencoded = counter, 0, 0
        self.root = self._over(leaves)
        self.touched = 0

    @classmethod
    def of(cls, counter: Counter, text: str) -> TokenTree:
        return cls(counter, counter.leaves(counter.cut(text)))

    def _made(self, left: Node, right: Node) -> Node:
        self.touched += 1
        return (max(left[0], right[0]) + 1, left[1] + right[1], left[2] + right[2], left[3] + right[3], left[4] + right[4], left, right)

    def _over(self, leaves: list[Node]) -> Node | None:
        while len(leaves) > 1:  # level by level, so that heights differ by one at most
            level = [self._made(a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
            if len(leaves) % 2:
                level[-1] = self._joined(level[-1], leaves[-1])
            leaves = level
        return leaves[0] if leaves else None

    def _balanced(self, left: Node, right: Node) -> Node:
        """A node over two trees whose heights differ by two at most."""
        if left[0] > right[0] + 1:
            a, b = left[5], left[6]
            return self._made(a, self._made(b, right)) if a[0] >= b[0] else self._made(self._made(a, b[5]), self._made(b[6], right))
        if right[0] > left[0] + 1:
            a, b = right[5], right[6]
            return self._made(self._made(left, a), b) if b[0] >= a[0] else self._made(self._made(left, a[5]), self._made(a[6], b))
        return self._made(left, right)

    def _joined(self, left: Node | None, right: Node | None) -> Node | None:
        """One balanced tree of two, in as many steps as their heights differ."""
        if left is None or right is None:
            return right if left is None else left
        if left[0] > right[0] + 1:
            return self._balanced(left[5], self._joined(left[6], right))
        if right[0] > left[0] + 1:
            return self._balanced(self._joined(left, right[5]), right[6])
        return self._made(left, right)

    def _split(self, node: Node | None, k: int) -> tuple[Node | None, Node | None]:
        """The first k leaves and the others."""
        if node is None or k <= 0:
            return None, node
        if k >= node[1]:
            return node, None
        if k <= node[5][1]:
            a, b = self._split(node[5], k)
            return a, self._joined(b, node[6])
        a, b = self._split(node[6], k - node[5][1])
        return self._joined(node[5], a), b

    @property
    def sums(self) -> tuple[int, int, int]:
        """Characters, pre-tokens and tokens."""
        return self.root[2:5] if self.root else (0, 0, 0)

    @property
    def size(self) -> int:
        return self.root[1] if self.root else 0

    def leaves(self, first: int = 0, stop: int | None = None) -> list[Node]:
        """The leaves from first to stop, in order."""
        stop = self.size if stop is None else min(stop, self.size)
        out, todo = [], [(self.root, 0)] if first < stop else []
        while todo:
            node, at = todo.pop()
            if node[6] is None:
                out.append(node)
                continue
            middle = at + node[5][1]
            if stop > middle:
                todo.append((node[6], middle))
            if first < middle:
                todo.append((node[5], at))
        return out

    @property
    def text(self) -> str:
        return "".join(x[5] for x in self.leaves())

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the position, and the position where that leaf starts; the last leaf beyond the end."""
        node, i, start = self.root, 0, 0
        while node[6] is not None:
            if position - start < node[5][2]:
                node = node[5]
            else:
                i, start, node = i + node[5][1], start + node[5][2], node[6]
        return i, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters from start to stop by new."""
        size = self.sums[0]
        start = min(max(0, start), size)
        stop = min(max(start, stop), size)
        first, at, last = 0, 0, 0
        if self.root:
            first, at = self.leaf_at(max(0, start - CONTEXT))
            last = self.leaf_at(stop)[0] + 1
        old = "".join(x[5] for x in self.leaves(first, last))
        region = old[: start - at] + new + old[stop - at :]
        while True:  # until an old boundary is one of the new text
            ahead, k = "", last
            while k < self.size and len(ahead) <= CONTEXT:
                ahead += self.leaves(k, k + 1)[0][5]
                k += 1
            pieces = self.counter.cut(region + ahead[: CONTEXT + 1])
            ends, done = [], 0
            for p in pieces:
                done += len(p)
                ends.append(done)
            found = bisect.bisect_left(ends, len(region))
            if not ahead or not region or ends[found] == len(region):
                pieces = pieces[: found + 1] if region else []
                break
            region += self.leaves(last, last + 1)[0][5]
            last += 1
        self.reencoded += len(region)
        fresh = self.counter.leaves(pieces)
        if len(pieces) < LEAF // 2:  # a small leaf is one with a neighbour, if that leaves room for edits
            for k, new_first, new_last in ((last, first, last + 1), (first - 1, first - 1, last)):
                near = self.leaves(k, k + 1) if 0 <= k < self.size else []
                if near and near[0][3] + len(pieces) <= 2 * LEAF:
                    parts = [*fresh, *near] if k == last else [*near, *fresh]
                    fresh = [leaf("".join(x[5] for x in parts), sum(x[3] for x in parts), sum(x[4] for x in parts))]
                    first, last = new_first, new_last
                    break
        head, rest = self._split(self.root, first)
        tail = self._split(rest, last - first)[1]
        self.touched += len(fresh)
        self.root = self._joined(self._joined(head, self._over(fresh)), tail)


EDITS = "array<struct<start:int,stop:int,text:string>>"
_SUMS = ["n_chars", "n_pretokens", "n_tokens"]
_LEAVES = {"leaf_texts": (5, pa.string(), "string"), "leaf_pretokens": (3, pa.int32(), "int"), "leaf_tokens": (4, pa.int32(), "int")}


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} array<{_LEAVES[c][2]}>" if c in _LEAVES else f"{c} long" for c in names)


def _batch(names: list[str], ids: list[int], trees: list[TokenTree], extra: dict[str, list[int]]) -> pa.RecordBatch:
    columns = {"doc_id": pa.array(ids, pa.int64())} | {c: pa.array([t.sums[k] for t in trees], pa.int64()) for k, c in enumerate(_SUMS)}
    leaves = [t.leaves() for t in trees] if _LEAVES.keys() & set(names) else []
    columns |= {c: pa.array([[x[k] for x in y] for y in leaves], pa.list_(kind)) for c, (k, kind, _) in _LEAVES.items() if leaves}
    columns |= {c: pa.array(v, pa.int64()) for c, v in extra.items()}
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def built(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens and the leaves (texts, pre-tokens, tokens) of each text's tree: what is kept of a document."""
    names = ["doc_id", *_SUMS, *_LEAVES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(ranks, pattern)
        for batch in slabs(batches):
            yield _batch(names, batch.column(0).to_pylist(), [TokenTree.of(counter, x) for x in texts_of(batch)], {})

    texts = positional(docs).select(F.col(column(docs, id_col)).cast("long").alias("doc_id"), F.col(column(docs, text_col)).cast("string").alias("text"))
    return texts.mapInArrow(run, _schema(names))


def edited(trees: DataFrame, edits: Column, ranks: bytes, pattern: str, keep: bool = True) -> DataFrame:
    """The trees that built() or edited() returned, after edits: an array of (start, stop, text) over their columns.

    Only what edits touch is encoded again; n_reencoded counts its characters, n_touched the nodes made anew; the sums
    before the edits are in n_chars_before, n_pretokens_before and n_tokens_before. keep: return the leaves, too.
    """
    names = ["doc_id", *_SUMS, *(_LEAVES if keep else ()), *[f"{c}_before" for c in _SUMS], "n_reencoded", "n_touched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(ranks, pattern)
        for batch in slabs(batches, "n_chars"):
            ids, texts, pieces, tokens, todo = (batch.column(c).to_pylist() for c in ("doc_id", *_LEAVES, "edits"))
            out = []
            for k in range(len(ids)):
                tree = TokenTree(counter, [leaf(*x) for x in zip(texts[k], pieces[k], tokens[k], strict=True)])
                for e in todo[k] or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                out.append(tree)
            before = {f"{c}_before": batch.column(c).to_pylist() for c in _SUMS}
            yield _batch(names, ids, out, before | {"n_reencoded": [t.reencoded for t in out], "n_touched": [t.touched for t in out]})

    return trees.select("doc_id", *_SUMS, *_LEAVES, edits.cast(EDITS).alias("edits")).mapInArrow(run, _schema(names))
