"""Edit-aware token counts on segment trees of pre-token segments.

A text is cut at sure pre-token borders (a non-space before a space or line end) into
segments of about ``SEGMENT`` characters, and at added tokens, so each segment's token
count stands alone. The segments are the leaves of a balanced tree whose nodes hold the
characters and tokens below them. An edit finds the segments that it touches, with the
neighbour where it reaches the characters that made the border sure, in logarithmic
time, re-encodes these alone, and joins what they become between the untouched subtrees,
whose sums stay; only the nodes on the way to the root are summed anew.

Trees are kept as rows: the characters and tokens of their leaves. The query keeps the
tree of every document, with the text where an edit is due, and counts the edited ones
from what was kept.

Edge cases: null texts count as empty; edits of an unknown id are ignored; edits apply
in order, each to the text that the ones before it left, and out of range ends are cut
to it; null ids are kept and take no edits from a table; repeated rows are counted
alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import frugal, materialize, workers_can_import
from radarlake.llm.op3_bpe import BORDER, Codec, codec, default_tokenizer

SEGMENT = 1024
#: What the query's edits replace: personal data in the documents.
PERSONAL = re.compile(r"(?P<EMAIL>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})|(?P<IP>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<PHONE>(?<![\w.])\+?\d[\d ()-]{7,16}\d(?![\w.]))")


def segments(code: Codec, text: str, size: int = SEGMENT) -> list[str]:
    """The text in pieces whose encodings laid end to end are the text's."""
    out = []
    for x in code.segments(text):
        at = 0
        while len(x) - at > size:
            m = BORDER.search(x, at + size - 1)
            if not m:
                break
            out.append(x[at : m.start() + 1])
            at = m.start() + 1
        out.append(x[at:])
    return out


class Node:
    """A segment with its token count, or two subtrees with their sums."""

    __slots__ = ("left", "right", "text", "chars", "tokens", "height")

    def __init__(self, left: Node | None, right: Node | None, text: str = "", tokens: int = 0):
        self.left, self.right, self.text = left, right, text
        self.chars = left.chars + right.chars if left else len(text)
        self.tokens = left.tokens + right.tokens if left else tokens
        self.height = 1 + max(left.height, right.height) if left else 0


def grown(leaves: list[Node]) -> Node | None:
    """A balanced tree over leaves."""
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return Node(grown(leaves[:half]), grown(leaves[half:]))


def _turned(left: Node, right: Node) -> Node:
    """A node over two subtrees whose heights may differ by two."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def joined(left: Node | None, right: Node | None) -> Node | None:
    if not left or not right:
        return left or right
    if left.height > right.height + 1:
        return _turned(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return _turned(joined(left, right.left), right.right)
    return Node(left, right)


def parted(tree: Node, at: int, after: bool) -> tuple[Node | None, Node | None]:
    """The leaves before the one that holds character ``at`` and the others; with ``after``, that one is among the first."""
    if not tree.left:
        return (tree, None) if after else (None, tree)
    if at < tree.left.chars:
        a, b = parted(tree.left, at, after)
        return a, joined(b, tree.right)
    a, b = parted(tree.right, at - tree.left.chars, after)
    return joined(tree.left, a), b


def leaves_of(tree: Node | None) -> Iterator[Node]:
    todo = [tree] if tree else []
    while todo:
        x = todo.pop()
        if x.left:
            todo += [x.right, x.left]
        else:
            yield x


class TokenTree:
    """The segment tree of one text."""

    def __init__(self, code: Codec, text: str, known: list[tuple[int, int]] | None = None):
        """known: (characters, tokens) of the segments, from an earlier tree of this text."""
        self.code, self.encoded = code, 0
        if known is None:
            self.root = grown(self._leaves(text))
        else:
            kept, at = [], 0
            for n, c in known:
                kept.append(Node(None, None, text[at : at + n], c))
                at += n
            self.root = grown(kept)

    def _leaves(self, text: str) -> list[Node]:
        self.encoded += len(text)
        return [Node(None, None, p, len(self.code.encode(p))) for p in segments(self.code, text)]

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end by ``new`` and re-encode what that touches."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        if not self.root:
            self.root = grown(self._leaves(new))
            return
        # a border needs the character before and after it; added tokens must not be formed or cut unseen
        reach = max((len(x) for x in self.code.added), default=1)
        before, rest = parted(self.root, max(start - reach, 0), False)
        first = before.chars if before else 0
        touched, after = parted(rest, min(end + reach, self.chars - 1) - first, True)
        text = "".join(x.text for x in leaves_of(touched))
        text = text[: start - first] + new + text[end - first :]
        self.root = joined(joined(before, grown(self._leaves(text))), after)

    def leaves(self) -> list[tuple[int, int]]:
        return [(x.chars, x.tokens) for x in leaves_of(self.root)]

    def text(self) -> str:
        return "".join(x.text for x in leaves_of(self.root))


def personal_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a tag for each piece of personal data, from the last to the first."""
    return [(m.start(), m.end(), f"[{m.lastgroup}]") for m in PERSONAL.finditer(text)][::-1]


def build(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees to keep: (id, n_tokens, leaves array<struct<chars, tokens>>)."""
    workers_can_import(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        leaf = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
        for b in batches:
            trees = [TokenTree(code, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tokens for t in trees], pa.int64()), pa.array([[{"chars": n, "tokens": c} for n, c in t.leaves()] for t in trees], leaf)], names=["id", "n_tokens", "leaves"])

    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"id {kind}, n_tokens long, leaves array<struct<chars: int, tokens: int>>").withColumnRenamed("id", id_col)


def _edited(src: DataFrame, tokenizer: str, edits_of: Callable) -> DataFrame:
    """src: (id, text, leaves, edits), the last two null where unknown."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        leaf = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
        for b in batches:
            rows = []
            for text, leaves, edits in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                text = text or ""
                tree = TokenTree(code, text, None if leaves is None else [(x["chars"], x["tokens"]) for x in leaves])
                before, seen, todo = tree.tokens, tree.encoded, edits_of(text, edits)
                for s, e, new in todo:
                    tree.edit(s, e, new)
                rows.append((before, len(todo), tree.tokens, tree.encoded - seen, [{"chars": n, "tokens": c} for n, c in tree.leaves()]))
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), leaf
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], names=["id", "n_tokens", "n_edits", "n_tokens_after", "chars_reencoded", "leaves"])

    return src.mapInArrow(frugal(run), f"id {kind}, n_tokens long, n_edits int, n_tokens_after long, chars_reencoded long, leaves array<struct<chars: int, tokens: int>>")


def update(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept trees after ``edits`` (id, seq, start, stop, new): only edited documents are read again."""
    workers_can_import(docs.sparkSession)
    todo = edits.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "new"))).alias("edits"))
    src = docs.select(id_col, text_col).join(trees.select(id_col, "leaves"), id_col).join(todo, id_col).select(F.col(id_col).alias("id"), F.col(text_col), "leaves", "edits")
    return _edited(src, tokenizer, lambda text, given: [(x["start"], x["stop"], x["new"]) for x in given]).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, tokenizer: str, edits_of: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees to keep (id, n_tokens, leaves), with the text and the edits of the documents that ``edits_of`` has some for."""
    workers_can_import(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        leaf = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
        edit = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            trees = [TokenTree(code, t) for t in texts]
            due = [[{"start": s, "stop": e, "new": new} for s, e, new in edits_of(t)] or None for t in texts]
            cols = [pa.array([t.tokens for t in trees], pa.int64()), pa.array([[{"chars": n, "tokens": c} for n, c in t.leaves()] for t in trees], leaf), pa.array([t if e else None for t, e in zip(texts, due, strict=True)], pa.string()), pa.array(due, edit)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "n_tokens", "leaves", "text", "edits"])

    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"id {kind}, n_tokens long, leaves array<struct<chars: int, tokens: int>>, text string, edits array<struct<start: int, stop: int, new: string>>").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Of each document: its tokens, and its tokens after personal data has been replaced by tags, counted on the kept tree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = materialize(keep(docs, default_tokenizer(), personal_edits))
    due = kept.filter("edits IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "leaves", "edits")
    got = _edited(due, default_tokenizer(), lambda _, given: [(x["start"], x["stop"], x["new"]) for x in given]).drop("leaves")
    same = kept.filter("edits IS NULL").select(F.col("doc_id").alias("id"), "n_tokens", F.lit(0).alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"), F.lit(0).cast("long").alias("chars_reencoded"))
    return same.unionByName(got).withColumnRenamed("id", "doc_id")
