"""Finding every repeated fixed-length window of a corpus without shipping every window.

A window (so many words, or bytes) is represented by the smallest hash among the shorter grams in
it, its anchor.  Equal windows have equal anchors at equal offsets, and consecutive windows mostly
share one: a maximal run of windows with the same anchor place is a *superwindow*.

Round 1 ships, per home and bucket of anchor values, the sorted distinct (anchor, check) pairs of
its superwindows - about two per hundred bytes - where check hashes the whole content.  The bucket
merges all homes in order: a pair seen before makes every window of its superwindow a repeat (or,
with verify, a candidate); an anchor with one content only has none; the first carriers of several
contents of one anchor are left open.  Round 2 ships just the open ones (and, with verify, the
candidates and what they may repeat), with content, and decides each of their windows exactly.

A frequent window costs a home one entry, however often it occurs there, so no bucket grows with
the number of copies.  Answers travel back as codes in the order in which entries were sent.
"""

from __future__ import annotations

import numpy as np
import zstandard

from siftwell.llm.rolling import avalanche, sliding_argmin, span_hashes


class Found:
    """Superwindows of a home in text order: anchor, check, anchor place, first window, number of windows."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
        self.anchor, self.check, self.place, self.first, self.number = cols
        order = np.lexsort((self.first, self.check, self.anchor))
        a, c = self.anchor[order], self.check[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(a) else np.zeros(0, bool)
        #: superwindows that are the first of their content in the home, by (anchor, check)
        self.heads = order[new]
        #: superwindows whose content occurs earlier in the home, and the head that holds it
        self.copies = order[~new]
        self.copied = self.heads[(np.cumsum(new) - 1)[~new]] if len(a) else self.heads


def find(values: np.ndarray, edges: np.ndarray, length: int, gram: int, chunk: int = 1 << 17) -> Found:
    """Superwindows of the value sequence; windows stay inside the documents given by edges."""
    parts = []
    for at in range(0, max(0, len(values) - length + 1), chunk):
        v = values[at : at + chunk + length - 1]
        grams = np.arange(len(v) - gram + 1)
        g = span_hashes(v, grams, grams + gram, 1)
        place = sliding_argmin(g, length - gram + 1)
        inside = np.ones(len(place), bool)  # windows over a document's end are none
        for e in edges[np.searchsorted(edges, at, side="right") : np.searchsorted(edges, at + len(v))].tolist():
            inside[max(0, e - length + 1 - at) : max(0, e - at)] = False
        start = np.flatnonzero(inside)
        if not len(start):
            continue
        where = place[start]
        new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)])
        first, where = start[new], where[new]
        end = start[np.r_[new[1:], len(start)] - 1]
        check = avalanche(span_hashes(v, first, end + length, 2) + (where - first).astype(np.uint64))
        # an anchor is the least of many hashes; mixed again its values spread evenly over buckets
        parts.append((avalanche(g[where]), check, where + at, first + at, end - first + 1))
    return Found(parts)


def squeeze(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as zstd of their differences, byte plane by byte plane."""
    d = np.diff(sorted_keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(8 * n, 1)), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (((anchor >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack_entries(anchor: np.ndarray, check: np.ndarray, home: np.ndarray | None = None) -> bytes:
    """Sorted entries as bytes: key planes, the 64 check bits of each, and for runs the home numbers."""
    keys = squeeze(anchor)
    tail = check.astype("<u8").tobytes()
    more = b"" if home is None else zstandard.ZstdCompressor(level=1).compress(home.astype("<i4").tobytes())
    return np.array([len(anchor), len(keys)], "<i8").tobytes() + keys + tail + more


def unpack_entries(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n, k = np.frombuffer(raw, "<i8", 2)
    anchor = unsqueeze(raw[16 : 16 + k], int(n))
    check = np.frombuffer(raw, "<u8", int(n), 16 + int(k))
    rest = raw[16 + k + 8 * n :]
    home = np.frombuffer(zstandard.ZstdDecompressor().decompress(rest, max_output_size=max(4 * int(n), 1)), "<i4") if rest else None
    return anchor, check, home


UNIQUE, REPEAT, OPEN = 0, 1, 2


def merged_order(anchor: np.ndarray, check: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The order by (anchor, check, home) of sorted runs that lie one behind the other.

    The stable sort is a merge of the ascending stretches that it finds, so the runs are merged,
    not sorted again; only entries that share an anchor are then put in order of their contents.
    """
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    same = np.r_[False, a[1:] == a[:-1]] if len(a) else np.zeros(0, bool)
    tied = np.flatnonzero(same | np.r_[same[1:], False]) if len(a) else np.zeros(0, np.int64)
    some = order[tied]
    order[tied] = some[np.lexsort((home[some], check[some], a[tied]))]
    return order


def judge(anchor: np.ndarray, check: np.ndarray, home: np.ndarray, old: np.ndarray, verify: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code per entry, which old entries must show their content, and which entries are their content's first.

    Entries of one home are distinct; old marks entries of the index, whose homes are smaller
    than all others.  With verify hashes only choose candidates: where an anchor has a new entry
    and any other one, all its entries are open.
    """
    order = merged_order(anchor, check, home)
    a, c = anchor[order], check[order]
    new_a = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    new_v = new_a | np.r_[True, c[1:] != c[:-1]] if len(a) else new_a
    group = np.cumsum(new_a) - 1
    several = (np.bincount(group, weights=np.ones(len(a)) if verify else new_v) > 1)[group] if len(a) else new_a
    fresh = (np.bincount(group, weights=(np.ones(len(a), bool) if verify else new_v) & ~old[order]) > 0)[group] if len(a) else new_a
    code = np.where(several & fresh, OPEN, UNIQUE).astype(np.uint8)
    if not verify:
        code[~new_v] = REPEAT
    out, first = np.empty(len(a), np.uint8), np.empty(len(a), bool)
    out[order], first[order] = code, new_v
    return out, old & (out == OPEN), first
