"""Substring dedup with compact windows.

The tokens are 5-word shingles (lower case, split at white space); a passage is
``SPAN`` tokens (50 words), and two are the same if their tokens have a Jaccard
similarity of 0.8 or more, which takes 41 tokens in common. One insertion, deletion,
substitution or cut inside a passage costs 4 or 5 neighbouring tokens, so there is at
most one, and one of the two sides that it leaves has ``RUN`` (21) tokens that both
passages have word for word.

For each of two hash functions, the Cartesian tree over a text's token hashes gives its
compact windows (l, c, r): every subsequence within l..r that holds c has its min-hash
at c. An interval join of the two lists, by position, gives the subsequences of RUN
tokens in groups (first, last) that share both min-hashes and so the tokens between the
two; these are the group's signature. A run that two texts share lies in groups of equal
signature. Members of a signature are linked in a star around
the first place that has it, never all pairs: a signature that many texts of a batch
hold first among these, and batches among each other, so one that a third of all texts
hold is one row a batch. Every place of a signature in a text is a member of its own. Each link is verified by tokens,
on its diagonal, for all passages that hold the shared run.

An exact repeat whose first text holds only a part of the passage fails against it. So
passages that were tried and aren't exact, all of whose runs have links, give a hash of
their whole content (128 bits), of the text and of the first text, and are linked by
that to the first text which has it, at each place: no star loses an exact repeat. Among
near copies these first texts change from place to place and grow with the group; so
such stretches are settled text by text, without a join, and only those that cover
words which no other row has are rows. The others are in the list ``also`` of a row, with
their sources. A repeat that is near but not exact is found
where a text that begins one of its signatures has it; it may be lost when all of these
hold only parts of it. The README gives the recall against brute force.

What moves is 20 bytes a signature (0.18 a token), each text once, to be met with its
links, and of texts in a link the tokens around them.

Edge cases: null, empty and short texts (under 50 words) have no passage; rows that
share an id are one document, which is no copy of itself; rows with a null id are
neither copies nor sources; ids that aren't integers are ordered by a hash; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarlake.llm.common import Memo, attach, discard, frugal, materialize, workers_can_import

SHINGLE = 5
SPAN = 46
RUN = 21
SIMILAR = 0.8
#: Tokens that two passages of SPAN tokens need in common.
COMMON = -int(-(2 * SPAN * SIMILAR / (1 + SIMILAR)) // 1)
HASHES = 2
#: A stretch of so many passages is compared word for word before it is compared by tokens.
LONG = 128
#: More pairs than this around one text are dealt to several rows.
STAR = 1024
BATCH_WORDS = 1 << 19
#: A signature that more places of a batch have is sent once, with links to its first place.
LOCAL = 16
ROWS = 1 << 16
WORD = re.compile(r"\S+")
#: Column names that documents do not use.
OWN = ("__radarlake_row", "__radarlake_spans")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
KEYS = ("<u8", "<i8", "<i4", "i1", "i1")  # signature, text, centre, first and last start from the centre
LINKS = ("<i8", "<i8", "<i4", "<i4", "<i4")  # text, other text, diagonal, first and last passage


def _hasher():
    import xxhash

    return Memo(xxhash.xxh64_intdigest)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    g = (h ^ np.uint64(_MIX[k + 1])) * np.uint64(_MIX[0])
    g = (g ^ (g >> np.uint64(31))) * np.uint64(_MIX[k + 1] | 1)
    return g ^ (g >> np.uint64(28))


@functools.lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, 2^bits of each."""
    return tuple(np.r_[np.uint64(1), np.cumprod(np.full((1 << bits) - 1, np.uint64(x)))] for x in (base, pow(base, -1, 1 << 64)))


def _sums(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): (sums[b] - sums[a]) * back[a] is a polynomial hash of h[a:b]."""
    power, back = _powers(base, max(len(h).bit_length(), 10))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)]))), back


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of each 5 consecutive words (the last four places are not valid)."""
    h = np.zeros(len(words), dtype=np.uint64)
    n = len(words) - SHINGLE + 1
    if n > 0:
        for k in range(SHINGLE):
            h[:n] = h[:n] * np.uint64(_MIX[0]) + words[k : k + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MIX[4])
        h ^= h >> np.uint64(29)
    return h


def compact_windows(h: np.ndarray, doc: np.ndarray, end: np.ndarray, span: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees of texts laid end to end, all at least span wide.

    h: token hashes, at most 2^22; doc: number of each token's text; end: first place
    after its text's tokens. Centres are the least tokens of sliding windows; l and r
    come from the nearest smaller centres, which are the nearest smaller tokens.
    """
    n = len(h)
    if n < span:
        return (np.array([], dtype=np.int64),) * 3
    low = np.uint64((1 << 22) - 1)
    packed = (h & ~low) | np.arange(n, dtype=np.uint64)
    wide = -(-n // span) * span
    grid = np.full(wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = packed
    grid = grid.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - span + 1)
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    starts = starts[(starts + span <= end[: n - span + 1])]
    c = (least[starts] & low).astype(np.int64)
    c = c[np.r_[True, c[1:] != c[:-1]]] if len(c) else c
    if not len(c):
        return c, c, c
    key, own, m = packed[c], doc[c], len(c)
    prev, nxt = np.arange(-1, m - 1), np.arange(1, m + 1)
    for near, dead in ((prev, -1), (nxt, m)):
        act = np.arange(m)
        while len(act):
            act = act[near[act] != dead]
            other = near[act]
            act = act[(own[other] == own[act]) & (key[other] > key[act])]
            near[act] = near[near[act]]
    begin = np.searchsorted(doc, own, side="left")
    has_l = (prev >= 0) & (own[np.maximum(prev, 0)] == own)
    has_r = (nxt < m) & (own[np.minimum(nxt, m - 1)] == own)
    left = np.where(has_l, c[np.maximum(prev, 0)] + 1, begin)
    right = np.where(has_r, c[np.minimum(nxt, m - 1)] - 1, end[c] - 1)
    return left, c, right


def signatures(h: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, centre, first, last): the interval join of the compact windows of all hash functions.

    Every subsequence of RUN tokens that starts at first..last has the signature's min-hashes.
    """
    none = np.array([], dtype=np.int64)
    at, value, starts = [], [], none
    for k in range(HASHES):
        g = _mixed(h, k)
        left, c, right = compact_windows(g, doc, end)
        first, last = np.maximum(left, c - RUN + 1), np.minimum(c, right - RUN + 1)
        many = last - first + 1
        starts = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at.append(np.repeat(c, many))
        value.append(g)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    cut = np.flatnonzero(np.r_[True, (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1])])
    first, last = starts[cut], starts[np.r_[cut[1:] - 1, len(starts) - 1]]
    a, b = at[0][cut], at[1][cut]
    lo, hi = np.minimum(a, b), np.maximum(a, b) + 1
    # all tokens between the two centres, by prefix sums of a polynomial modulo 2^64
    sums, back = _sums(h, _MIX[0])
    between = (sums[hi] - sums[lo]) * back[lo]
    key = _mixed(value[0][a] * np.uint64(_MIX[2]) + value[1][b] + (b - a).astype(np.uint64) * np.uint64(_MIX[3]) + between * np.uint64(_MIX[1]), 2)
    return key, a, first, last


def star(key, text, centre, lo, hi, few: int = 0) -> tuple[np.ndarray, tuple]:
    """(places of the first member of each signature, links of the others to it).

    Members of signatures that have at most ``few`` are all given, without a link.
    """
    order = np.lexsort((centre, text, key))
    if not len(order):
        return order, (order,) * 5
    key, text, centre, lo, hi = (x[order] for x in (key, text, centre, lo, hi))
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    size = np.diff(np.r_[np.flatnonzero(new), len(key)])
    new |= np.repeat(size <= few, size)
    rest = np.flatnonzero(~new)
    head, c = first[rest], centre[rest].astype(np.int64)
    # a passage that holds a run which starts at t starts at t - (SPAN - RUN) .. t
    links = text[rest], text[head], (centre[head] - c).astype(np.int64), c + lo[rest] - (SPAN - RUN), c + hi[rest]
    return order[new], links


def merged(text, other, far, lo, hi) -> tuple:
    """Links on one diagonal of two texts, their intervals united."""
    if not len(text):
        return text, other, far, lo, hi
    order = np.lexsort((lo, far, other, text))
    text, other, far, lo, hi = (x[order].astype(np.int64) for x in (text, other, far, lo, hi))
    new = np.r_[True, (text[1:] != text[:-1]) | (other[1:] != other[:-1]) | (far[1:] != far[:-1])]
    group = np.cumsum(new) << 40
    reach = np.maximum.accumulate(hi + group)
    new[1:] |= (lo + group)[1:] > reach[:-1] + 1
    cut = np.flatnonzero(new)
    return text[cut], other[cut], far[cut], lo[cut], np.maximum.reduceat(hi, cut)


def pack(columns, kinds) -> bytes:
    """Columns as bytes, the first byte of all values before the second, which packs well."""
    return b"".join(np.ascontiguousarray(np.asarray(c).astype(k)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, k in zip(columns, kinds, strict=True))


def unpack(raws: list[bytes], kinds) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list] = [[] for _ in kinds]
    for raw in raws:
        n, at = len(raw) // size, 0
        for k, kind in enumerate(kinds):
            wide = np.dtype(kind).itemsize
            out[k].append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).ravel())
            at += n * wide
    return [np.concatenate(x) if x else np.array([], dtype=k) for x, k in zip(out, kinds, strict=True)]


def _pieces(texts: Iterator[tuple[int, str | None]]) -> Iterator[list[tuple[int, list[str], int]]]:
    """Batches of (text, words, place of the first); a very long text is cut with an overlap."""
    part, size, step = [], 0, 1 << 21
    for text, raw in texts:
        words = (raw or "").lower().split()
        if len(words) < SPAN + SHINGLE - 1:
            continue
        for at in range(0, max(len(words) - RUN - SHINGLE + 2, 1), step - RUN - SHINGLE):
            part.append((text, words[at : at + step], at))
            size += len(part[-1][1])
            if size >= BATCH_WORDS:
                yield part
                part, size = [], 0
    if part:
        yield part


def _members(part: list[tuple[int, list[str], int]], memo) -> tuple[np.ndarray, ...]:
    """(signature, text, centre, first and last start from the centre) of a batch."""
    sizes = np.array([len(w) for _, w, _ in part])
    words = np.fromiter(map(memo.__getitem__, chain.from_iterable(ws for _, ws, _ in part)), dtype=np.uint64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(part)), sizes)
    key, c, first, last = signatures(shingles(words), doc, (ends - SHINGLE + 1)[doc])
    begin, shift = ends - sizes, np.array([at for _, _, at in part])
    text = np.array([t for t, _, _ in part], dtype=np.int64)[doc[c]]
    return key, text, c - begin[doc[c]] + shift[doc[c]], first - c, last - c


def _tokens(text: str, memo) -> np.ndarray:
    """Shingle hashes."""
    words = np.fromiter(map(memo.__getitem__, text.lower().split()), dtype=np.uint64)
    return shingles(words)[: max(len(words) - SHINGLE + 1, 0)]


def _numbered(w: np.ndarray) -> np.ndarray:
    """Windows (one a row) whose k-th token of a kind is told from the others of the window."""
    w = np.sort(w, axis=1)
    at = np.broadcast_to(np.arange(w.shape[1]), w.shape)
    new = np.ones(w.shape, dtype=bool)
    new[:, 1:] = w[:, 1:] != w[:, :-1]
    nth = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
    return w + nth.astype(np.uint64) * np.uint64(_MIX[1])


def similarities(a: np.ndarray, b: np.ndarray, tries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tried, best, shift) of each passage of a: the best Jaccard similarity on the diagonals tried.

    tries: (diagonal, first, last) of passages of a to be compared with b. Similarities
    of passages that can't reach SIMILAR are given as 0.
    """
    n = max(len(a) - SPAN + 1, 0)
    tried, best, shift = np.zeros(n, dtype=bool), np.zeros(n), np.zeros(n, dtype=np.int64)
    if not n or len(b) < SPAN:
        return tried, best, shift
    order = np.argsort(b, kind="stable")
    kinds = b[order]
    at = np.searchsorted(kinds, a)
    match = np.where(kinds[np.minimum(at, len(b) - 1)] == a, order[np.minimum(at, len(b) - 1)], -(1 << 40))
    able = np.concatenate(([0], np.cumsum(match >= 0)))
    able = able[SPAN:] - able[:-SPAN] >= COMMON
    starts, fars = [], []
    for far, lo, hi in tries:
        lo, hi = max(lo, 0), min(hi, n - 1)
        if hi < lo:
            continue
        tried[lo : hi + 1] = True
        s, e = max(lo, -far), min(hi, len(b) - SPAN - far)
        if e - s >= LONG:  # word for word, at once
            same = np.r_[0, np.cumsum(a[s : e + SPAN] == b[s + far : e + SPAN + far])]
            done = s + np.flatnonzero(same[SPAN:] - same[:-SPAN] == SPAN)
            best[done], shift[done] = 1.0, far
        i = lo + np.flatnonzero(able[lo : hi + 1] & (best[lo : hi + 1] < 1.0))
        starts.append(i)
        fars.append(np.full(len(i), far))
    starts, fars = (np.concatenate(x) if x else np.array([], dtype=np.int64) for x in (starts, fars))
    if not len(starts):
        return tried, best, shift
    # tokens that one of the two has more than once are matched window by window
    own = np.sort(a)
    often = np.searchsorted(kinds, a, "right") - at > 1
    often |= np.searchsorted(own, a, "right") - np.searchsorted(own, a) > 1
    often = np.concatenate(([0], np.cumsum(often & (match >= 0))))
    often = often[SPAN:] > often[:-SPAN]
    view = np.lib.stride_tricks.sliding_window_view
    places, tokens, others = view(match, SPAN), view(a, SPAN), view(b, SPAN)
    for k in range(0, len(starts), 20_000):
        i, far = starts[k : k + 20_000], fars[k : k + 20_000]
        todo = best[i] < 1.0
        i, far = i[todo], far[todo]
        j = np.clip(i + far, 0, len(b) - SPAN)
        got = places[i] - j[:, None]
        common = ((got >= 0) & (got < SPAN)).sum(axis=1)
        slow = often[i]
        if slow.any():
            both = np.sort(np.concatenate((_numbered(tokens[i[slow]]), _numbered(others[j[slow]])), axis=1), axis=1)
            common[slow] = (both[:, 1:] == both[:, :-1]).sum(axis=1)
        jac = common / (2 * SPAN - common)
        # the same passage may be tried on several diagonals
        order = np.lexsort((jac, i))
        i, j, jac = i[order], j[order], jac[order]
        last = np.r_[i[1:] != i[:-1], True] if len(i) else np.array([], dtype=bool)
        i, j, jac = i[last], j[last], jac[last]
        up = jac > best[i]
        best[i[up]], shift[i[up]] = jac[up], (j - i)[up]
    return tried, best, shift


def passages(a: np.ndarray, b: np.ndarray, best: np.ndarray, shift: np.ndarray, similar: float = SIMILAR) -> list[tuple[int, int, int, float]]:
    """(first word, end, first word in b, similarity) of the stretches of a that b has."""
    good = np.flatnonzero(best >= similar - 1e-12)
    out = []
    if not len(good):
        return out
    has = np.isin(a, b)
    cut = np.flatnonzero(np.diff(good) > SPAN)
    for lo, hi in zip(np.r_[0, cut + 1], np.r_[cut, len(good) - 1], strict=True):
        s, e = good[lo], good[hi] + SPAN
        hit = np.flatnonzero(has[s:e])
        first, last = s + int(hit[0]), s + int(hit[-1]) + SHINGLE
        out.append((first, last, max(int(first + shift[good[lo]]), 0), float(best[good[lo : hi + 1]].max())))
    return out


def contents(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the tokens of the passages that start at ``at``."""
    out = []
    for base in (_MIX[2], _MIX[4]):
        sums, back = _sums(_mixed(h, 3), base)
        out.append(_mixed((sums[at + SPAN] - sums[at]) * back[at], 1).view(np.int64))
    return out[0], out[1]


def cut_out(tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, bytes]:
    """(places, tokens) of the passages that start at lo..hi: united stretches, and their tokens one after the other."""
    lo, hi = np.clip(lo, 0, len(tokens)), np.clip(hi + SPAN, 0, len(tokens))
    kept = hi > lo
    order = np.argsort(lo[kept], kind="stable")
    lo, hi = lo[kept][order], hi[kept][order]
    if not len(lo):
        return b"", b""
    reach = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    lo, hi = lo[new], np.r_[reach[new[1:] - 1], reach[-1]]
    short = (tokens >> np.uint64(32)).astype("<u4")
    return np.stack([lo, hi]).astype("<i4").tobytes(), np.concatenate([short[a:b] for a, b in zip(lo, hi, strict=True)]).tobytes()


def covered(n: int, spans: np.ndarray) -> bytes:
    """Stretches (first, last) of the passages of a text of n tokens all of whose runs are linked.

    spans: the passages that links are tried for. Only such a passage can be an exact
    repeat of another one that isn't a link's first place itself.
    """
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, np.clip(spans[:, 0] + SPAN - RUN, 0, n), 1)
    np.add.at(mark, np.clip(spans[:, 1] + 1, 0, n), -1)
    runs = np.r_[0, np.cumsum(np.cumsum(mark[:n]) > 0)]
    wide = SPAN - RUN + 1
    good = np.r_[False, runs[wide:] - runs[:-wide] == wide, False].astype(np.int8)
    turn = np.diff(good)
    return np.stack([np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1]).astype("<i4").tobytes()


def _spread(stretches: bytes, first: int, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, dtype=np.int64)
    lo, hi = np.frombuffer(stretches, dtype="<i4").reshape(2, -1).astype(np.int64) - first
    np.add.at(mark, np.clip(lo, 0, n), 1)
    np.add.at(mark, np.clip(hi + 1, 0, n), -1)
    return np.cumsum(mark[:n]) > 0


def _dense(places: bytes, tokens: bytes, gap: int) -> tuple[np.ndarray, int]:
    """Tokens at their places, from the first one on; ``gap`` (0 or 1, no token) between."""
    lo, hi = np.frombuffer(places, dtype="<i4").reshape(2, -1).astype(np.int64)
    tokens = np.frombuffer(tokens, dtype="<u4").astype(np.uint64) + np.uint64(2)
    out = np.full(int(hi[-1] - lo[0]), gap, dtype=np.uint64)
    sizes = hi - lo
    out[np.repeat(lo - lo[0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(tokens))] = tokens
    return out, int(lo[0])


def _rows(kinds: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def _nested(lists: pa.ListArray, name: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Rows of array<struct<name, tries array<struct<far, lo, hi>>>> as lists of (number, tries)."""
    of, inner = lists.offsets.to_numpy(), lists.values
    numbers, tries = inner.field(name).to_pylist(), inner.field("tries")
    cut = tries.offsets.to_numpy()
    flat = np.stack([tries.values.field(x).to_numpy().astype(np.int64) for x in ("far", "lo", "hi")], axis=1)
    for a, b in zip(of[:-1], of[1:], strict=True):
        yield [(numbers[k], flat[cut[k] : cut[k + 1]]) for k in range(a, b)]


def _links(src: DataFrame) -> DataFrame:
    """(text, pairs array<(other, tries array<(far, lo, hi)>)>) of the texts (num, text) that share a signature."""
    buckets = 16 * int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(kinds, where, columns, links: bool):
        order = np.argsort(where, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0])[: len(order)]
        rows = [pack([c[order[a:b]] for c in columns], kinds) for a, b in zip(cut, [*cut[1:], len(order)], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(where[order[cut]].astype(np.int32)), pa.array([links] * len(rows), pa.bool_()), pa.array(rows, pa.binary())], names=["bucket", "links", "data"])

    def scan(batches):
        memo = _hasher()
        for part in _pieces((t, x) for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            cols = _members(part, memo)
            first, links = star(*cols, few=LOCAL)
            links = merged(*links)
            yield dealt(KEYS, (cols[0][first] % np.uint64(buckets)).astype(np.int64), [c[first] for c in cols], False)
            yield dealt(LINKS, (_mixed(links[0].astype(np.int64).view(np.uint64), 1) % np.uint64(buckets)).astype(np.int64), links, True)

    def meet(batches):
        keys, links = [], []
        for b in batches:
            for is_link, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                (links if is_link else keys).append(raw)
        _, new = star(*unpack(keys, KEYS))
        keys.clear()
        text, other, far, lo, hi = merged(*(np.concatenate(x) for x in zip(unpack(links, LINKS), new, strict=True)))
        for k in range(0, len(text), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + ROWS].astype(t)) for x, t in ((text, "i8"), (other, "i8"), (far, "i4"), (lo, "i4"), (hi, "i4"))], names=["num", "other", "far", "lo", "hi"])

    met = src.select("num", "text").mapInArrow(frugal(scan), "bucket int, links boolean, data binary").repartition("bucket")
    met = met.mapInArrow(frugal(meet, 1 << 20), "num long, other long, far int, lo int, hi int")
    pairs = met.repartition("num").groupBy("num", "other").agg(F.collect_list(F.struct("far", "lo", "hi")).alias("tries"))
    return pairs.groupBy("num").agg(F.collect_list(F.struct("other", "tries")).alias("pairs"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, first_word, n_words, source, source_word, similarity, also): passages that an earlier text has.

    also: (first_word, n_words, source, source_word) of exact repeats whose words the
    text's rows cover. rid, a hash of id and text, tells rows apart that share an id.
    """
    workers_can_import(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id IS NOT NULL")
    whole = src.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    src = src.withColumn("num", F.col("id").cast("long") if whole else F.xxhash64("id"))
    kind = src.schema["id"].dataType.simpleString()
    linked = materialize(_links(src))

    texts = src.select("num", "id", F.xxhash64("id", "text").alias("rid"), "text")
    names = ["num", "other", "id", "rid", "places", "tokens"]

    def mine(batches):
        memo = _hasher()
        for b in batches:
            types = dict(zip([*names, "tries", "able"], (pa.int64(), pa.int64(), b.schema.field("id").type, pa.int64(), *(pa.binary(),) * 4), strict=True))
            rows = []
            for num, i, rid, text, pairs in zip(*(b.column(n).to_pylist() for n in ("num", "id", "rid", "text")), _nested(b.column("pairs"), "other"), strict=True):
                tokens = _tokens(text, memo)
                able = covered(len(tokens), np.concatenate([x for _, x in pairs])[:, 1:])
                for other, tries in pairs:
                    places, own = cut_out(tokens, tries[:, 1], tries[:, 2])
                    if places:
                        rows.append((num, other, i, rid, places, own, tries.astype("<i4").tobytes(), able))
            yield _rows(types, rows)

    def theirs(batches):
        memo = _hasher()
        for b in batches:
            types = dict(zip(names, (pa.int64(), pa.int64(), b.schema.field("id").type, pa.int64(), pa.binary(), pa.binary()), strict=True))
            rows = []
            for num, i, rid, text, asked in zip(*(b.column(n).to_pylist() for n in ("num", "id", "rid", "text")), _nested(b.column("asked"), "num"), strict=True):
                tokens = _tokens(text, memo)
                for x, tries in asked:
                    places, own = cut_out(tokens, tries[:, 1] + tries[:, 0], tries[:, 2] + tries[:, 0])
                    if places:
                        rows.append((x, num, i, rid, places, own))
            yield _rows(types, rows)

    schema = f"num long, other long, id {kind}, rid long, places binary, tokens binary"
    own = texts.join(linked, "num").mapInArrow(frugal(mine, 64), schema + ", tries binary, able binary")
    asked = linked.select("num", F.explode("pairs").alias("p")).filter("p.other <> num").select("num", F.col("p.other").alias("other"), F.col("p.tries").alias("tries"))
    many = materialize(asked.groupBy("other").agg(F.count(F.lit(1)).alias("n")).select("other", "n", F.ceil(F.col("n") / STAR).cast("int").alias("deal")))
    asked = attach(asked, many, "other", "n").groupBy("other", F.pmod(F.xxhash64("num"), F.col("deal")).alias("salt")).agg(F.collect_list(F.struct("num", "tries")).alias("asked"))
    others = texts.join(asked.withColumnRenamed("other", "num"), "num").mapInArrow(frugal(theirs, 16), schema)
    others = others.select("num", "other", *(F.col(c).alias(f"b_{c}") for c in ("id", "rid", "places", "tokens")))

    def verify(batches):
        """kind 0: a passage that the other text has; 1: the contents of those that aren't word for word there; 2: of the other text."""
        for b in batches:
            i_kind = b.schema.field("id").type
            types = {"kind": pa.int32(), "num": pa.int64(), "id": i_kind, "rid": pa.int64(), "first_word": pa.int32(), "n_words": pa.int32(), "source": i_kind, "source_word": pa.int32(), "similarity": pa.float64(), "w": pa.int64(), "v": pa.int64(), "at": pa.list_(pa.int32())}
            rows, spots = [], []
            for r in b.to_pylist():
                if not r["places"]:
                    continue
                x, p = _dense(r["places"], r["tokens"], 0)
                able = _spread(r["able"], p, max(len(x) - SPAN + 1, 0))
                tries = np.frombuffer(r["tries"], dtype="<i4").reshape(-1, 3)
                if r["num"] == r["other"]:  # another place in this text: other texts may have it
                    lost = np.zeros(len(able) + 1, dtype=np.int64)
                    np.add.at(lost, np.clip(tries[:, 1] - p, 0, len(able)), 1)
                    np.add.at(lost, np.clip(tries[:, 2] - p + 1, 0, len(able)), -1)
                    lost = [(x, np.flatnonzero((np.cumsum(lost[:-1]) > 0) & able), p, "")]
                elif not r["b_places"]:
                    continue
                else:
                    y, q = _dense(r["b_places"], r["b_tokens"], 1)
                    tries = [(far + p - q, lo - p, hi - p) for far, lo, hi in tries.tolist()]
                    tried, best, shift = similarities(x, y, tries)
                    for s, e, t, j in passages(x, y, best, shift):
                        rows.append((0, r["num"], r["id"], r["rid"], s + p, e - s, r["b_id"], t + q, j, None, None, None))
                    # not word for word: found by its content, in whichever text
                    able &= tried & (best < 1.0)
                    lost = [(x, np.flatnonzero(able), p, ""), (y, _shifted(tries, able, len(y)), q, "b_")] if able.any() else []
                for h, at, o, name in lost:
                    gaps = np.r_[0, np.cumsum(h < 2)]
                    at = at[gaps[at + SPAN] == gaps[at]]
                    if not len(at):
                        continue
                    w, v = contents(h, at)
                    order = np.lexsort((at, v, w))
                    w, v, at = w[order], v[order], at[order] + o
                    new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
                    if name:  # a source needs one place
                        spots.append((2, r["other"], r["b_id"], r["b_rid"], w[new], v[new], np.ones(len(new), np.int64), at[new]))
                    else:
                        spots.append((1, r["num"], r["id"], r["rid"], w[new], v[new], np.diff(np.r_[new, len(at)]), at))
            yield _rows(types, rows)
            for k in range(0, len(spots), 1024):
                some = spots[k : k + 1024]
                each = pa.array(np.repeat(np.arange(len(some)), [len(x[4]) for x in some]))
                what, num, i, rid = (pa.array([x[j] for x in some], t).take(each) for j, t in enumerate((pa.int32(), pa.int64(), i_kind, pa.int64())))
                w, v, many, at = (np.concatenate([x[j] for x in some]) for j in (4, 5, 6, 7))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(at.astype(np.int32)))
                given = {"kind": what, "num": num, "id": i, "rid": rid, "w": pa.array(w), "v": pa.array(v), "at": lists}
                yield pa.RecordBatch.from_arrays([given.get(n, pa.nulls(len(w), t)) for n, t in types.items()], names=list(types))

    fields = f"id {kind}, rid long, first_word int, n_words int, source {kind}, source_word int, similarity double"
    seen = materialize(own.join(others, ["num", "other"], "left").mapInArrow(frugal(verify), f"kind int, num long, {fields}, w long, v long, at array<int>"))
    discard(linked, many)
    near = seen.filter("kind = 0").select("rid", "id", "source", F.array("first_word").alias("at"), "source_word", "n_words", "similarity")

    spots = seen.filter("kind > 0").select(F.struct("w", "v").alias("key"), "kind", "num", "id", "rid", "at")
    first = spots.groupBy("key").agg(F.min(F.struct("num", "id", F.col("at")[0].alias("c"))).alias("x"), F.max("num").alias("last"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("n")).filter("x.num < last AND n > 0")
    first = materialize(first.select("key", F.col("x.num").alias("other"), F.col("x.id").alias("source"), F.col("x.c").alias("bc"), "n"))
    again = attach(spots.filter("kind = 1"), first, "key", "n").filter("num <> other")
    again = again.select("rid", "id", "source", "at", F.col("bc").alias("source_word"), F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("double").alias("similarity"))

    def settle(batches):
        for rows in _by_text(batches):
            yield from rows_of(rows).to_batches()

    also = f"also array<struct<first_word: int, n_words: int, source: {kind}, source_word: int>>"
    return near.unionByName(again).repartition("rid").sortWithinPartitions("rid").mapInArrow(frugal(settle, ROWS), f"{fields}, {also}")


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole texts from rows sorted by rid."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        rid = b.column("rid").to_numpy()
        if not len(rid):
            continue
        last = int(np.searchsorted(rid, rid[-1]))
        if last or held and held[-1].column("rid")[-1].as_py() != rid[0]:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def cover(text: np.ndarray, first: np.ndarray, end: np.ndarray, near: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which stretches of texts are needed for all of their words that no near passage (text, first, end) has.

    Both ends grow from stretch to stretch of a text, so from each one that is kept the
    next is the last that it touches.
    """
    base, lo, hi = text << 40, (text << 40) + first, (text << 40) + end
    if len(near[0]):  # less what near passages have at either end
        order = np.lexsort((near[1], near[0]))
        begin, reach = ((near[0] << 40) + near[1])[order], np.maximum.accumulate(((near[0] << 40) + near[2])[order])
        new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
        begin, reach = begin[new], reach[np.r_[new[1:], len(reach)] - 1]
        lo = np.maximum(lo, np.where((k := np.searchsorted(begin, lo, "right") - 1) >= 0, reach[k], 0))
        k = np.searchsorted(reach, hi, "left")
        hi = np.minimum(hi, np.where(k < len(begin), begin[np.minimum(k, len(begin) - 1)], hi))
    need = np.flatnonzero(lo < hi)
    lo, hi = lo[need], hi[need]
    after = np.maximum(np.searchsorted(lo, hi, "right") - 1, np.arange(1, len(need) + 1)).tolist()
    kept, k = np.zeros(len(base), dtype=bool), 0
    while k < len(need):
        kept[need[k]], k = True, after[k]
    return kept


def rows_of(rows: pa.Table) -> pa.Table:
    """The result for some texts, sorted by rid, from their near passages and the places (no similarity) of their exact ones.

    Places that follow each other and have one source are a stretch. Near passages and
    the stretches that cover the rest are rows; each other stretch is in the ``also`` of
    the last row that starts no later. So the sources which a group of near copies
    gives to a text make its lists longer, not its rows more.
    """
    rid, at = rows["rid"].to_numpy(), rows["at"].combine_chunks()
    text = np.cumsum(np.r_[False, rid[1:] != rid[:-1]]).astype(np.int64)
    source = rows["source"].combine_chunks().dictionary_encode().indices.to_numpy()
    each, place = np.repeat(np.arange(len(rid)), at.value_lengths().to_numpy()), at.flatten().to_numpy().astype(np.int64)
    whole = rows["similarity"].is_valid().to_numpy()[each]
    # near passages, each once
    row, first = each[whole], place[whole]
    many, close = (rows[n].take(pa.array(row)).to_numpy() for n in ("n_words", "similarity"))
    start = rows["source_word"].take(pa.array(row)).to_numpy()
    once = np.unique(np.stack([text[row], first, many, source[row], start, close.view(np.int64)]), axis=1, return_index=True)[1]
    near = row[once], first[once], first[once] + many[once]
    # a place has one content, and so one source
    row, c = each[~whole], place[~whole]
    order = np.lexsort((c, text[row]))
    row, c = row[order], c[order]
    once = np.r_[True, (np.diff(text[row]) != 0) | (np.diff(c) != 0)][: len(c)]
    row, c = row[once], c[once]
    new = np.flatnonzero(np.r_[True, (np.diff(text[row]) != 0) | (np.diff(c) != 1) | (np.diff(source[row]) != 0)][: len(c)])
    row, first, end = row[new], c[new], c[np.r_[new[1:], len(c)][: len(new)] - 1] + SPAN + SHINGLE - 1
    main = cover(text[row], first, end, (text[near[0]], *near[1:]))

    row, first, end, rest = (np.r_[near[0], row[main]], np.r_[near[1], first[main]], np.r_[near[2], end[main]], (row[~main], first[~main], end[~main]))
    order = np.lexsort((end, first, text[row]))
    row, first, end = row[order], first[order], end[order]
    under = np.searchsorted((text[row] << 40) + first, (text[rest[0]] << 40) + rest[1], "right")
    column = lambda name, row: rows[name].take(pa.array(row)).combine_chunks()
    lists = pa.StructArray.from_arrays([pa.array(rest[1], pa.int32()), pa.array(rest[2] - rest[1], pa.int32()), column("source", rest[0]), column("source_word", rest[0])], names=["first_word", "n_words", "source", "source_word"])
    also = pa.ListArray.from_arrays(pa.array(np.searchsorted(under, np.arange(len(row) + 1), "right").astype(np.int32)), lists)
    out = {"id": column("id", row), "rid": column("rid", row), "first_word": pa.array(first, pa.int32()), "n_words": pa.array(end - first, pa.int32()), "source": column("source", row), "source_word": column("source_word", row)}
    return pa.table(out | {"similarity": column("similarity", row).fill_null(1.0), "also": also})


def _shifted(tries, failed: np.ndarray, n: int) -> np.ndarray:
    """Passages of the other text that the failed ones were compared with."""
    mark = np.zeros(max(n - SPAN + 1, 0), dtype=bool)
    for far, lo, hi in tries:
        lo, hi = max(lo, -far, 0), min(hi, len(failed) - 1, len(mark) - 1 - far)
        if hi >= lo:
            mark[lo + far : hi + far + 1] |= failed[lo : hi + 1]
    return np.flatnonzero(mark)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document left without a word goes."""
    spans = materialize(find(docs).groupBy("rid").agg(F.collect_set(F.struct("first_word", "n_words")).alias("spans")))
    spans = spans.select(F.col("rid").alias(OWN[0]), F.col("spans").alias(OWN[1])).hint("merge")  # at any size: they grow with the table
    known = docs.withColumn(OWN[0], F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).join(spans, OWN[0], "left").select(*docs.columns, OWN[1])
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        for b in batches:
            found = b.column(b.num_columns - 1).to_pylist()
            texts = [t if not spans else without(t, [(x["first_word"], x["n_words"]) for x in spans]) for t, spans in zip(b.column(at).to_pylist(), found, strict=True)]
            keep = [not spans or bool(t.strip()) for t, spans in zip(texts, found, strict=True)]
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            if count is not None:
                cols[count] = pa.array([n if not s else len(t) for n, t, s in zip(b.column(count).to_pylist(), texts, found, strict=True)], cols[count].type)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return known.mapInArrow(frugal(cut), docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans (first word, number of words)."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for s, n in sorted(spans):
        lo, hi = at[min(s, len(at) - 1)], at[min(s + n, len(at) - 1)]
        if lo > done:
            out.append(text[done:lo])
        done = max(done, hi)
    return "".join(out) + text[done:]


def query(spark, sf_dir: str) -> DataFrame:
    """One row for each passage that an earlier document has: doc_id, its words, the source, and exact repeats inside with theirs."""
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    also = F.transform("also", lambda x: F.struct(x["first_word"].alias("first_word"), x["n_words"].alias("n_words"), x["source"].alias("source_doc_id"), x["source_word"].alias("source_word")))
    return got.select(F.col("id").alias("doc_id"), "first_word", "n_words", F.col("source").alias("source_doc_id"), "source_word", F.round("similarity", 6).alias("similarity"), also.alias("also"))
