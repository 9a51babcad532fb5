"""Fill-in-middle transformation of texts held as ropes.

A rope is a balanced tree. Its leaves hold pieces of a text and cache how many units and code points the pieces have; inner
nodes cache the sums. A unit is a word with the white space before it; white space at the end is a unit of its own. Leaves
hold whole units, so that a tree is split at a unit rank by one walk from the root, and only the leaf that the rank falls
into is scanned. Two splits cut a text into prefix, middle and suffix; the output is the concatenation of these subtrees in
another order, with leaves for the sentinels between them. The inverse splits the output's tree at the sentinels.

Every row of the input gives one row. A null text is the empty text; empty texts, texts that hold a sentinel and those that
the rate leaves out stay as they are (form plain, no prefix or middle). A null id is written as no digits. Work and memory
are proportional to a text's length; no row needs another.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metergrid.llm.common import arrow_map

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a leaf.
LEAF = 256
# Possessive, so that a text of fewer units than a leaf fails at once.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"
FULL_LEAF = re.compile(f"{UNIT}{{{LEAF}}}")
ONE_UNIT = re.compile(rf"{UNIT}|[\x20\x09-\x0D]++")


@dataclass(slots=True)
class Rope:
    """A leaf has a piece, an inner node two subtrees."""

    units: int
    chars: int
    depth: int = 0
    piece: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(piece: str, units: int) -> Rope:
    return Rope(units, len(piece), 0, piece) if piece else EMPTY


def concat(left: Rope, right: Rope) -> Rope:
    """Both trees one after the other. Where one is much deeper, the other goes down its near edge, so that depth stays
    logarithmic."""
    if not left.chars:
        return right
    if not right.chars:
        return left
    if left.depth > right.depth + 1:
        return _node(left.left, concat(left.right, right))
    if right.depth > left.depth + 1:
        return _node(concat(left, right.left), right.right)
    return _node(left, right)


def _node(left: Rope, right: Rope) -> Rope:
    # one rotation where the subtree that grew became too deep
    if left.depth > right.depth + 1:
        return _join(left.left, _join(left.right, right))
    if right.depth > left.depth + 1:
        return _join(_join(left, right.left), right.right)
    return _join(left, right)


def _join(left: Rope, right: Rope) -> Rope:
    return Rope(left.units + right.units, left.chars + right.chars, 1 + max(left.depth, right.depth), "", left, right)


def rope(text: str) -> Rope:
    """The tree of a text, built level by level from its leaves."""
    level, at = [], 0
    while found := FULL_LEAF.match(text, at):
        level.append(leaf(found[0], LEAF))
        at = found.end()
    if at < len(text):
        level.append(leaf(text[at:], len(ONE_UNIT.findall(text, at))))
    while len(level) > 1:
        pairs = [_join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else EMPTY


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= tree.units:
        return tree, EMPTY
    if tree.left is None:
        at = 0
        for _ in range(rank):
            at = ONE_UNIT.match(tree.piece, at).end()
        return leaf(tree.piece[:at], rank), leaf(tree.piece[at:], tree.units - rank)
    if rank < tree.left.units:
        first, rest = split_units(tree.left, rank)
        return first, concat(rest, tree.right)
    first, rest = split_units(tree.right, rank - tree.left.units)
    return concat(tree.left, first), rest


def split_chars(tree: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` code points, and the rest. A unit that is cut counts in both parts."""
    if at <= 0:
        return EMPTY, tree
    if at >= tree.chars:
        return tree, EMPTY
    if tree.left is None:
        return tuple(leaf(x, len(ONE_UNIT.findall(x))) for x in (tree.piece[:at], tree.piece[at:]))
    if at < tree.left.chars:
        first, rest = split_chars(tree.left, at)
        return first, concat(rest, tree.right)
    first, rest = split_chars(tree.right, at - tree.left.chars)
    return concat(tree.left, first), rest


def written(tree: Rope) -> str:
    pieces, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.left is None:
            pieces.append(node.piece)
        else:
            todo += (node.right, node.left)
    return "".join(pieces)


def sentinel(name: str) -> Rope:
    return leaf(name, 0)


def draws(row_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))


def transform(text: str, row_id: int | None, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    tree, (h1, h2, h3, h4) = rope(text), draws(row_id, seed)
    n = tree.units
    if not n or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split_units(tree, high)
    prefix, middle = split_units(head, low)
    if h4 % 100 < spm:
        form, order = "spm", (sentinel(SUFFIX), suffix, sentinel(PREFIX), prefix, sentinel(MIDDLE), middle)
    else:
        form, order = "psm", (sentinel(PREFIX), prefix, sentinel(SUFFIX), suffix, sentinel(MIDDLE), middle)
    out = EMPTY
    for part in order:
        out = concat(out, part)
    return n, form, prefix.chars, middle.chars, written(out)


def restore(output: str | None, form: str | None) -> str | None:
    """The text from an output and its form; null where the output is null or lacks a sentinel of its form."""
    if output is None or form not in ("psm", "spm"):
        return output
    if any(x not in output for x in (PREFIX, SUFFIX, MIDDLE)):
        return None
    second = PREFIX if form == "spm" else SUFFIX
    middle_at = output.rindex(MIDDLE)
    second_at = output.index(second)
    head, middle = split_chars(rope(output), middle_at)
    first, other = split_chars(head, second_at)
    first, other, middle = (split_chars(x, len(PREFIX))[1] for x in (first, other, middle))
    prefix, suffix = (other, first) if form == "spm" else (first, other)
    return written(concat(concat(prefix, middle), suffix))


def fill_in_middle(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80, carry: list[str] | None = None
) -> DataFrame:
    """The rows of docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output. `rate` percent of
    the rows are transformed, `spm` percent of them with the suffix first."""
    outputs = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def make():
        def step(part: pa.RecordBatch):
            texts, ids = part.column(text_col).to_pylist(), part.column(id_col).to_pylist()
            return list(zip(*(transform(t or "", i, seed, rate, spm) for t, i in zip(texts, ids, strict=True)), strict=True))

        return step

    return arrow_map(docs, text_col, outputs, make, carry, reads=(id_col,))


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", carry: list[str] | None = None) -> DataFrame:
    """The rows with `restored`, the text rebuilt from output and form alone."""
    outputs = T.StructType().add("restored", "string")

    def make():
        return lambda part: [[restore(o, f) for o, f in zip(part.column(output_col).to_pylist(), part.column(form_col).to_pylist(), strict=True)]]

    return arrow_map(rows, output_col, outputs, make, carry, reads=(form_col,))
