"""BPE encoding and decoding by tree concatenation.

A text up to ``leaf_chars`` is encoded in one go. A longer one is halved again and
again, at a sure pre-token border (a non-space before a space or line end) nearest
to the middle. A run without such a border is cut into its pre-tokens, and a
pre-token that is still too long into halves of its bytes. All leaves are rows of
their own, so they are encoded in parallel; halves of a pre-token are then joined by
re-encoding a window around the join that grows until its first token is the one that
the left side has there and its last token the one that the right side has. A BPE
sequence is right exactly if each pair of neighbours is right, and every pair is then
one of the left encoding, of the window or of the right encoding.

Edge cases: a null text counts as empty (no ids, empty decoded text); a null id stays
null; repeated rows give repeated results; an empty table gives an empty table; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import frugal, workers_can_import

LEAF_CHARS = 32_768
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BORDER = re.compile(r"\S[ \n]")
TEXT, WORDS, PART = 0, 1, 2


def _byte_chars() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        chars, vocab, merges = _byte_chars(), said["model"]["vocab"], said["model"]["merges"]
        added = {x["content"]: x["id"] for x in said["added_tokens"]}
        if said["normalizer"] or said["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        if any(x[k] for x in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in white space")
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in added}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        made = [vocab["".join(p)] for p in pairs]
        if made != sorted(made):
            raise ValueError(f"{path}: ids are not in the order of merges")
        self.added = added
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def segments(self, text: str) -> list[str]:
        """Texts between added tokens, and the added tokens themselves."""
        return [x for x in self.cut.split(text) if x] if self.cut and any(a in text for a in self.added) else [text] if text else []

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for x in self.segments(text):
            out += [self.added[x]] if x in self.added else self.bpe.encode_ordinary(x)
        return out

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.bpe._encode_single_piece(raw)

    def decode(self, ids: list[int]) -> bytes:
        return self.bpe.decode_bytes(ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of a pre-token from those of its two parts."""
        if not left or not right:
            return left or right
        w = 4
        while True:
            a, b = max(len(left) - w, 0), min(w, len(right))
            window = self.piece(self.decode(left[a:] + right[:b]))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            w *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def long_piece(self, raw: bytes, leaf: int) -> list[int]:
        return self.tree([self.piece(x) for x in halves(raw, leaf)])


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(raw: bytes, leaf: int) -> list[bytes]:
    if len(raw) <= leaf:
        return [raw]
    mid = len(raw) // 2
    return halves(raw[:mid], leaf) + halves(raw[mid:], leaf)


def _border(text: str, lo: int, hi: int) -> int:
    """The sure border nearest to the middle of text[lo:hi], or -1."""
    mid, found, w = (lo + hi) // 2, [], 256
    if m := BORDER.search(text, mid, hi):
        found.append(m.start() + 1)
    while True:
        at = max(lo, mid - w)
        back = [m.start() + 1 for m in BORDER.finditer(text, at, min(mid + 1, hi))]
        if back:
            found.append(back[-1])
        if back or at == lo or (found and found[0] - mid <= w):
            break
        w *= 4
    return min((x for x in found if lo < x < hi), key=lambda x: abs(x - mid), default=-1)


def leaves(code: Codec, text: str, leaf: int) -> Iterator[tuple[int, str | None, bytes | None, list[int] | None, int]]:
    """Of a long text: (kind, text, bytes, lengths of pre-tokens, number of the halved pre-token)."""
    import regex

    group = 0

    def run(x: str):
        """A run without a border inside, by its pre-tokens."""
        nonlocal group
        words, size = [], 0
        for m in regex.finditer(PATTERN, x):
            word = m.group()
            if len(word) > leaf:
                if words:
                    yield WORDS, "".join(words), None, [len(w) for w in words], 0
                group, words, size = group + 1, [], 0
                for part in halves(word.encode(), leaf):
                    yield PART, None, part, None, group
                continue
            words.append(word)
            size += len(word)
            if size >= leaf:
                yield WORDS, "".join(words), None, [len(w) for w in words], 0
                words, size = [], 0
        if words:
            yield WORDS, "".join(words), None, [len(w) for w in words], 0

    for x in code.segments(text):
        todo = [(0, len(x))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf or x in code.added:
                yield TEXT, x[lo:hi], None, None, 0
            elif (at := _border(x, lo, hi)) > 0:
                todo += [(at, hi), (lo, at)]
            else:
                yield from run(x[lo:hi])


def _packed(ids: list[int]) -> bytes:
    import numpy as np

    return np.array(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, ids_le, decoded): ids packed as little-endian unsigned 32-bit integers, and their text.

    Only texts above ``leaf_chars`` are shuffled: by leaf to be encoded, by text to be joined.
    """
    workers_can_import(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out_schema = f"id {kind}, ids_le binary, decoded string"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for b in batches:
            packed, decoded = [], []
            for text in b.column(1):
                ids = code.encode(text.as_py())
                packed.append(_packed(ids))
                decoded.append(code.decode(ids).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=["id", "ids_le", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names = codec(tokenizer), ["id", "sha", "n", "leaf", "kind", "text", "raw", "cuts", "grp"]
        for b in batches:
            for i, sha, text, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows = list(leaves(code, text, leaf_chars))
                cols = [pa.array([i] * len(rows), b.schema.field(0).type), pa.array([sha] * len(rows), pa.string()), pa.array([n] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32())]
                kinds = (pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.int32())
                yield pa.RecordBatch.from_arrays(cols + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for b in batches:
            ids = []
            for k, text, raw, cuts in zip(*(b.column(c).to_pylist() for c in ("kind", "text", "raw", "cuts")), strict=True):
                if k == TEXT:
                    got = code.encode(text)
                elif k == PART:
                    got = code.piece(raw)
                else:
                    got, at = [], 0
                    for n in cuts:
                        got += code.piece(text[at : at + n].encode())
                        at += n
                ids.append(_packed(got))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "sha", "n", "leaf", "kind", "grp")), pa.array(ids, pa.binary())], names=["id", "sha", "n", "leaf", "kind", "grp", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        import numpy as np

        code, table = codec(tokenizer), table.sort_by("leaf")
        ids: list[int] = []
        parts: list[list[int]] = []
        at = 0
        for k, grp, raw in zip(*(table.column(c).to_pylist() for c in ("kind", "grp", "ids")), strict=True):
            if parts and (k != PART or grp != at):
                ids += code.tree(parts)
                parts = []
            got, at = np.frombuffer(raw, dtype="<u4").tolist(), grp
            if k == PART:
                parts.append(got)
            else:
                ids += got
        ids += code.tree(parts)
        one = table.slice(0, 1)
        return pa.table([one.column("id"), one.column("n"), pa.array([_packed(ids)], pa.binary()), pa.array([code.decode(ids).decode("utf-8", "replace")], pa.string())], names=["id", "n", "ids_le", "decoded"])

    few = src.filter(F.length("text") <= leaf_chars).mapInArrow(frugal(short, 256), out_schema)
    long = src.filter(F.length("text") > leaf_chars).groupBy("id", F.sha2("text", 256).alias("sha"), "text").agg(F.count(F.lit(1)).alias("n")).select("id", "sha", "text", "n")
    pieces = long.mapInArrow(frugal(cut, 16), f"id {kind}, sha string, n long, leaf int, kind int, text string, raw binary, cuts array<int>, grp int")
    pieces = pieces.repartition("id", "sha", "leaf").mapInArrow(frugal(leaf_ids, 32), f"id {kind}, sha string, n long, leaf int, kind int, grp int, ids binary")
    whole = pieces.groupBy("id", "sha").applyInArrow(joined, f"id {kind}, n long, ids_le binary, decoded string")
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id", "ids_le", "decoded")
    return few.unionByName(whole).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the kept documents: doc_id, n_tokens, ids_le."""
    got = encode(docs, default_tokenizer())
    return got.select("doc_id", (F.length("ids_le") / 4).cast("long").alias("n_tokens"), "ids_le")


def query(spark, sf_dir: str) -> DataFrame:
    got = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return got.select("doc_id", (F.length("ids_le") / 4).cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
