"""Benchmark decontamination: windows within an edit distance of benchmark items.

The CGK random walk embeds a window so that few edits become few differing places: step j writes the byte it stands on
and moves on if a random bit of (j, byte) says so. Repeated bit sampling takes some places of the embedding as a key. Windows
start at every word (and at bytes chosen by content inside very long words), in documents and, as shifted
windows, at every such place of the items; so each stretch of an item that is free of edits gives a key of its own, and
the chance that all of them miss falls with the item's length. How many steps of the walk a key takes, how many repeats
there are and whether windows start at every byte is chosen by items' length, words and allowance: the cheapest search
that finds TARGET of simulated copies with as many random edits as are allowed. Every window of a document whose key an
item has becomes a candidate with a shift; its stretch of 64 bytes is tested first, for many candidates at once, then the
exact edit distance of the whole item to the best place in the window's neighbourhood (bit-parallel over the item). An item is found if the distance is at most (1 - similarity) of its length.

Texts are compared with A-Z lower-cased and white space as blanks. Items travel in slices of at most `slice_bytes`, each
broadcast by itself; a task reads its documents once, some HELD bytes at a time, and loads one slice after the other for
them, so a benchmark of any size needs a bounded table in memory. Documents are read, never shuffled.

Items shorter than `least` bytes match runs of whole words only (white space, marks and unspaced scripts part them; runs of
blanks are one), with the same allowance. Their search is complete: of allowance + 1 pieces of an item one is free of edits,
so every place of a document that begins like a piece is a candidate.

Defined cases: null and empty texts or items match nothing; equal items are reported each; repeated documents are reported
each; a null doc_id is reported as null; texts of any length are searched whole, some windows at a time; of equally good
places the first is reported; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .spans import LOWER, MARKS, SPACE, chunks, mix, utf8
from .workspace import per_batch

STEPS, SEED = 48, 20240607
#: Steps of the embedding after which a key can end; half of the steps are sampled.
DEPTHS = (8, 12, 16, 20, 24, 32, 48)
#: Share of copies at the full allowance that the simulated search must find, the copies, and (every byte, repeats) by cost.
TARGET, COPIES, CHOICES = 0.97, 256, ((False, 2), (False, 4), (True, 2), (True, 4), (True, 8))
#: Candidates tested at once, windows walked at once, bytes of documents that a task holds for all slices of items.
BATCH = 1 << 13
WINDOWS = 1 << 18
HELD = 32 << 20
BLANK = np.where(SPACE, 0x20, LOWER).astype(np.uint8)


def walk_bits(repeat: int) -> np.ndarray:
    return np.random.default_rng(SEED + repeat).integers(0, 2, (STEPS, 256)).astype(np.int32)


def sampled(repeat: int) -> set[int]:
    """Places of the embedding in the key: two of every four steps."""
    rng = np.random.default_rng(SEED + 1000 + repeat)
    return {j + int(x) for j in range(0, STEPS, 4) for x in rng.choice(4, 2, replace=False)}


def walk(text: np.ndarray, starts: np.ndarray, repeat: int, seen: dict | None = None):
    """Yields (depth, windows, their keys, where they end): the sampled places up to each depth as one hash.

    seen: for each depth a table by the first bits of the keys; the walk ends there for windows that it lacks."""
    lo = int(starts.min()) if len(starts) else 0  # the walk reads up to STEPS bytes from the last start
    padded = np.append(text[lo : int(starts.max()) + STEPS if len(starts) else 0], np.zeros(STEPS, np.uint8))
    bits, places, starts = walk_bits(repeat), sampled(repeat), starts - lo
    kept, at, out = np.arange(len(starts)), starts.astype(np.int32), np.full(len(starts), repeat + 1, np.uint64)
    for j in range(STEPS if seen is None else max(seen, default=0)):
        c = padded[at]
        if j in places:
            out = out * np.uint64(0x100000001B3) + c
        at += bits[j][c]
        if j + 1 in DEPTHS if seen is None else j + 1 in seen:
            k = mix(out)
            if seen is not None:
                table = seen[j + 1]
                some = np.flatnonzero(table[(k >> np.uint64(65 - len(table).bit_length())).astype(np.int64)])
                kept, at, out, k = kept[some], at[some], out[some], k[some]
            yield j + 1, kept, k, at.astype(np.int64) + lo


def edited(text: np.ndarray, edits: int, rng) -> np.ndarray:
    """text after random changes, losses and gains of single bytes."""
    out = text.tolist()
    for _ in range(edits):
        kind, at, c = rng.integers(3), int(rng.integers(len(out))), int(text[rng.integers(len(text))])
        if kind == 0:
            out[at] = c
        elif kind == 1:
            out.insert(at, c)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint8)


def window_starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which windows start: words, and in words of over 32 bytes those whose three bytes hash to it."""
    if not len(text):
        return np.zeros(0, np.int64)
    gap = text == 0x20
    head = np.ones(len(text), bool)
    head[1:] = gap[:-1]
    head[offsets[:-1][offsets[:-1] < len(text)]] = True
    words = np.flatnonzero(~gap & head)
    size = np.diff(np.append(words, len(text)))
    long = words[size > 32]
    if not len(long):
        return words
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, long, 1)
    np.add.at(inside, np.minimum(long + size[size > 32], len(text)), -1)
    t = np.append(text, [0, 0]).astype(np.int64)
    chosen = (np.cumsum(inside)[:-1] > 0) & ~gap & (((t[:-2] * 31 + t[1:-1] * 17 + t[2:] * 7) & 7) == 0)
    return np.union1d(words, np.flatnonzero(chosen))


def best_place(item: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of item to any part of text, the end of the first such part)."""
    m, mask = len(item), (1 << len(item)) - 1
    at: dict[int, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    top, pv, mv, score, best, end = 1 << (m - 1), mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq | mv
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        score += (ph & top > 0) - (mh & top > 0)
        xv = eq | mv
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def edges(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a word can start or end at each place of the rows: beside white space and ASCII marks, at a row's ends, and
    on either side of a character of an unspaced script."""
    here = np.append(text, 0x20)
    before = np.concatenate(([0x20], text))
    wide = (here >= 0xE3) & (here <= 0xED)  # first bytes of U+3000 to U+DFFF
    after = np.zeros(len(here), bool)
    after[3:] = wide[:-3]
    out = MARKS[here] | MARKS[before] | wide | after
    out[offsets] = True
    return out & ((here & 0xC0) != 0x80)


def from_start(item: bytes, text: bytes):
    """The edit distances of item to each beginning of text, from the empty one on."""
    m, mask = len(item), (1 << len(item)) - 1
    at: dict[int, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    top, pv, mv, score = 1 << (m - 1), mask, 0, m
    yield score
    for c in text:
        eq = at.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq | mv
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        score += (ph & top > 0) - (mh & top > 0)
        yield score
        xv = eq | mv
        ph, mh = (ph << 1 | 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv


def all_starts(text: np.ndarray, offsets: np.ndarray, every: bool) -> np.ndarray:
    return np.arange(len(text)) if every else window_starts(text, offsets)


class Items:
    def __init__(self, rows: list[tuple], similarity: float, least: int):
        self.rows = [(i, BLANK[np.frombuffer((x or "").encode(), np.uint8)].tobytes().strip(b" ")) for i, x in rows]
        self.allowed = [int((1 - similarity) * len(x) + 1e-9) for _, x in self.rows]
        self.short = [n for n, (_, x) in enumerate(self.rows) if 0 < len(x) < least]
        kinds: dict[tuple, list[int]] = {}
        for n, (_, x) in enumerate(self.rows):
            if len(x) >= least:
                text = np.frombuffer(x, np.uint8)
                starts = len(window_starts(text, np.array([0, len(x)])))
                kinds.setdefault((int(np.log(len(x)) / np.log(1.1)), int(2 * np.log2(starts + 1))), []).append(n)
        self.plans = {}
        for members in kinds.values():
            plan = self._plan(members)
            self.plans |= dict.fromkeys(members, plan)
        self._index()
        self._pieces()
        self._blocks()

    def _plan(self, members: list[int]) -> tuple[bool, int, int]:
        """(every byte, repeats, depth): the cheapest search that finds TARGET of copies at the full allowance.

        Simulated on copies of some of these items, which are alike in length and words."""
        rng = np.random.default_rng(SEED)
        some = members[:: -(-len(members) // 8)]
        texts = [np.frombuffer(self.rows[n][1], np.uint8) for n in some]
        copies = [(i, edited(texts[i], self.allowed[some[i]], rng)) for i in range(len(some)) for _ in range(-(-COPIES // len(some)))]
        best = (-1.0, (True, CHOICES[-1][1], DEPTHS[0]))
        for every in (False, True):
            hit = {d: np.zeros(len(copies), bool) for d in DEPTHS}
            starts = [all_starts(x, np.array([0, len(x)]), every) for x in texts]
            buf = np.concatenate([x for _, c in copies for x in (np.full(STEPS, 0x20, np.uint8), c)])
            first = np.cumsum([STEPS + len(c) for _, c in copies]) - [len(c) for _, c in copies]
            where = np.concatenate([f + all_starts(c, np.array([0, len(c)]), every) for f, (_, c) in zip(first, copies, strict=True)])
            copy = np.searchsorted(first, where, "right") - 1
            repeats = {r for e, r in CHOICES if e == every}
            for r in range(max(repeats)):
                own = [{d: (k[e < len(x)], starts[i][w[e < len(x)]]) for d, w, k, e in walk(x, starts[i], r)} for i, x in enumerate(texts)]
                for d, w, k, _ in walk(buf, where, r):
                    for c in np.flatnonzero(~hit[d]):
                        lo, hi = np.searchsorted(copy, c), np.searchsorted(copy, c, "right")
                        i = copies[c][0]
                        keys, shift = own[i][d]
                        a, b = np.nonzero(keys[:, None] == k[None, lo:hi])
                        hit[d][c] = bool((abs(shift[a] - (where[lo:hi][b] - first[c])) <= self.allowed[some[i]]).any())
                if r + 1 in repeats:
                    for d in reversed(DEPTHS):
                        share = float(hit[d].mean())
                        if share >= TARGET:
                            return every, r + 1, d
                        best = max(best, (share, (every, r + 1, d)))
        return best[1]

    def _index(self):
        """Sorted keys by (every byte, repeat, depth), and the tables that end walks early."""
        held: dict[tuple, list] = {}
        prefixes: dict[tuple, list] = {}
        for n, (every, repeats, depth) in self.plans.items():
            text = np.frombuffer(self.rows[n][1], np.uint8)
            starts = all_starts(text, np.array([0, len(text)]), every)
            for r in range(repeats):
                found = {d: (k, e) for d, _, k, e in walk(text, starts, r)}
                k, end = found[depth]
                whole = end < len(text)  # the walk read nothing behind the item
                held.setdefault((every, r, depth), []).append((k[whole], np.full(whole.sum(), n), starts[whole]))
                for d in DEPTHS[: DEPTHS.index(depth) + 1]:
                    prefixes.setdefault((every, r, d), []).append(found[d][0][whole])
        self.index, self.seen = {}, {}
        for key, parts in held.items():
            k, item, shift = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(k, kind="stable")
            self.index[key] = k[order], item[order], shift[order]
        least = {}
        for every, r, d in held:
            least[every, r] = min(d, least.get((every, r), STEPS))
        for (every, r, d), parts in prefixes.items():
            if d >= least[every, r]:
                k = np.concatenate(parts)
                bits = min(24, max(12, len(k).bit_length() + 4))
                table = np.zeros(1 << bits, bool)
                table[(k >> np.uint64(64 - bits)).astype(np.int64)] = True
                self.seen.setdefault((every, r), {})[d] = table

    def _pieces(self):
        """Of the short items' pieces the first up to four bytes, by their number: (codes in order, items, shifts)."""
        held: dict[int, list] = {}
        for n in self.short:
            x, parts = self.rows[n][1], self.allowed[n] + 1
            size = min(4, len(x) // parts)
            for at in range(0, size and len(x) - len(x) // parts + 1, len(x) // parts):
                held.setdefault(size, []).append((int.from_bytes(x[at : at + size], "big"), n, at))
        self.pieces = {size: tuple(np.array(c, np.int64) for c in zip(*sorted(parts), strict=True)) for size, parts in held.items()}

    def _short_tries(self, text):
        """(item, place) pairs of places that begin like a piece of a short item, less its shift, after the first test."""
        for size, (code, item, shift) in self.pieces.items():
            if len(text) < size:
                continue
            own = np.zeros(len(text) - size + 1, np.uint32)
            for j in range(size):
                own = (own << np.uint32(8)) | text[j : len(text) - size + 1 + j]
            some = np.zeros(1 << 16, bool)  # by the two last bytes
            some[code & 0xFFFF] = True
            hits = np.flatnonzero(some[own & 0xFFFF])
            for a in range(0, len(hits), WINDOWS):
                w = hits[a : a + WINDOWS]
                lo, hi = np.searchsorted(code, own[w]), np.searchsorted(code, own[w], "right")
                w, n, lo = w[hi > lo], (hi - lo)[hi > lo], lo[hi > lo]
                e = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pair = np.unique(np.stack([item[e], np.repeat(w, n) - shift[e]]), axis=1) if len(e) else np.zeros((2, 0), np.int64)
                good = self._near(text, self.first_block[pair[0]], pair[1])
                yield from zip(pair[0][good].tolist(), pair[1][good].tolist(), strict=True)

    def _found_short(self, text, offsets, out):
        """Adds to each row the short items that a run of its whole words is within the allowance of."""
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != 0x20) | (text[:-1] != 0x20)
        fresh[offsets[:-1][offsets[:-1] < len(text)]] = True
        place = np.flatnonzero(fresh)
        flat, ends = text[fresh], np.searchsorted(place, offsets)
        can = edges(flat, ends)
        for n, at in sorted(set(self._short_tries(flat))):
            item, slack = self.rows[n][1], self.allowed[n]
            row = int(np.searchsorted(ends, max(0, min(at + len(item) // 2, len(flat) - 1)), "right")) - 1
            lo, hi = int(ends[row]), int(ends[row + 1])
            for s in range(max(lo, at - slack), min(hi, at + slack) + 1):
                if can[s]:
                    for j, d in enumerate(from_start(item, flat[s : min(hi, s + len(item) + slack)].tobytes())):
                        if j and can[s + j] and d <= slack and (n not in out[row] or d < out[row][n][0]):
                            out[row][n] = (d, int(place[s] - offsets[row]), int(place[s + j - 1] + 1 - offsets[row]))

    def _blocks(self):
        """Stretches of 64 bytes of the items, for a first test of candidates, as bit masks by the low five bits of a byte.

        A stretch around a shared key in a copy holds more than the limit of edits only if they crowd there, and then
        the keys of other stretches are more. For items of up to 64 bytes the test is exact but for equal low bits."""
        self.block_of, starts, sizes, limits, masks = {}, [], [], [], []
        for n in [*self.plans, *self.short]:
            x, slack = np.frombuffer(self.rows[n][1], np.uint8), self.allowed[n]
            m = min(64, len(x))
            rate = slack / len(x)
            self.block_of[n] = (len(starts), len(x))
            for at in [*range(0, len(x) - m, 32), len(x) - m]:
                mask = np.zeros(32, np.uint64)
                np.bitwise_or.at(mask, x[at : at + m] & 31, np.uint64(1) << np.arange(m, dtype=np.uint64))
                starts.append(at)
                sizes.append(m)
                limits.append(slack if m == len(x) else int(m * rate + 3 * (m * rate * (1 - rate)) ** 0.5))
                masks.append(mask)
        self.block_at, self.block_size, self.block_limit = np.array(starts, np.int64), np.array(sizes, np.int64), np.array(limits, np.int64)
        self.masks = np.array(masks, np.uint64).reshape(-1, 32)
        self.first_block, self.item_size, self.slack = (np.zeros(len(self.rows), np.int64) for _ in range(3))
        for n, (b, size) in self.block_of.items():
            self.first_block[n], self.item_size[n], self.slack[n] = b, size, self.allowed[n]

    def _block(self, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The block of the item around each shift."""
        size = self.item_size[item]
        last = np.where(size > 64, -(-(size - 64) // 32), 0)
        return self.first_block[item] + np.clip((shift - 16) // 32, 0, last)

    def _near(self, text: np.ndarray, block: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the block lies within its limit of a part of text around each place (bit-parallel over the block)."""
        ok = np.zeros(len(block), bool)
        low = text & 31
        one = np.uint64(1)
        for lo in range(0, len(block), BATCH):
            b = block[lo : lo + BATCH]
            m, limit = self.block_size[b], self.block_limit[b]
            begin = at[lo : lo + BATCH] - limit
            shift = (m - 1).astype(np.uint64)
            full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - shift)
            pv, mv, score, best = full.copy(), np.zeros(len(b), np.uint64), m.copy(), m.copy()
            base = b * 32
            flat = self.masks.reshape(-1)
            for j in range(int((m + 2 * limit).max(initial=0))):
                place = np.clip(begin + j, 0, len(text) - 1)
                eq = flat[base + low[place]]
                xh = (((eq & pv) + pv) ^ pv) | eq | mv
                ph, mh = mv | ~(xh | pv), pv & xh
                score += ((ph >> shift) & one).astype(np.int64) - ((mh >> shift) & one).astype(np.int64)
                xv = eq | mv
                ph, mh = ph << one, mh << one
                pv, mv = mh | ~(xv | ph), ph & xv
                np.minimum(best, score, out=best)
            ok[lo : lo + BATCH] = best <= limit
        return ok

    def _tries(self, text, offsets) -> set[tuple[int, int, int]]:
        """(row, item, place) of windows that share a key with an item and pass the first test."""
        tries = set()
        for every, r in sorted(self.seen):
            whole = all_starts(text, offsets, every)
            runs = (whole[a : a + WINDOWS] for a in range(0, len(whole), WINDOWS))
            for starts, (depth, windows, k, _) in ((s, x) for s in runs for x in walk(text, s, r, self.seen[every, r])):
                if (every, r, depth) not in self.index:
                    continue
                keys, item, shift = self.index[every, r, depth]
                lo, hi = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
                hit = np.flatnonzero(hi > lo)
                ends = np.cumsum((hi - lo)[hit])
                a = 0
                while a < len(hit):  # some hundred thousand candidates at once
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18), "right")))
                    x = hit[a:b]
                    n = hi[x] - lo[x]
                    e = np.repeat(lo[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    w = starts[windows[np.repeat(x, n)]]
                    place, of = w - shift[e], item[e]
                    block = self._block(of, shift[e])
                    spot, first = np.unique(np.stack([block, place]), axis=1, return_index=True)
                    good = first[self._near(text, spot[0], spot[1] + self.block_at[spot[0]])]
                    row = np.searchsorted(offsets, w[good], "right") - 1
                    tries.update(zip(row.tolist(), of[good].tolist(), place[good].tolist(), strict=True))
                    a = b
        return tries

    def found(self, buf, offsets):
        """For each row a list of (item number, distance, start, end), one for each item found, at its best place."""
        text = BLANK[buf]
        tries = self._tries(text, offsets) if len(text) else set()
        out = [{} for _ in range(len(offsets) - 1)]
        covered = {}
        for row, n, at in sorted(tries):
            item, slack = self.rows[n][1], self.allowed[n]
            if at <= covered.get((row, n), -1):
                continue  # shifts this near were in the neighbourhood that was searched
            lo, hi = max(int(offsets[row]), at - slack), min(int(offsets[row + 1]), at + len(item) + 2 * slack + slack // 2)
            covered[row, n] = at + slack // 2
            distance, end = best_place(item, text[lo:hi].tobytes())
            if distance <= slack and (n not in out[row] or distance < out[row][n][0]):
                begin = self._begin(item, text[lo : lo + end].tobytes())
                base = int(offsets[row])
                out[row][n] = (distance, lo + begin - base, lo + end - base)
        if self.short and len(text):
            self._found_short(text, offsets, out)
        return [[(n, *x) for n, x in sorted(o.items())] for o in out]

    @staticmethod
    def _begin(item: bytes, text: bytes) -> int:
        """Where the best part that ends with text starts."""
        _, end = best_place(item[::-1], text[::-1][: 2 * len(item)])
        return len(text) - end


def slices(benchmark: DataFrame, similarity: float, least: int, slice_bytes: int, item: str, text: str):
    """The items in slices of bounded size, in order of id."""
    held, size = [], 0
    for r in benchmark.select(item, text).orderBy(item, text).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= slice_bytes:
            yield Items(held, similarity, least)
            held, size = [], 0
    if held:
        yield Items(held, similarity, least)


def searched(batches, shared, at: int):
    """(record batch, for each row [(slice, item number, distance, start, end)]) of all batches, held some at a time."""

    def found(held):
        out = [[[] for _ in range(b.num_rows)] for b in held]
        for n, part in enumerate(shared):
            items = part.value
            for batch, rows in zip(held, out, strict=True):
                buf, offsets = utf8(batch.column(at))
                for lo, _, b, o in chunks(buf, offsets):
                    for i, got in enumerate(items.found(b, o)):
                        rows[lo + i] += [(n, *g) for g in got]
            if len(shared) > 1:
                part.__dict__.pop("_value", None)  # read again for the next documents
        return zip(held, out, strict=True)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD or len(shared) == 1:
            yield from found(held)
            held, size = [], 0
    if held:
        yield from found(held)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least: int = 32, slice_bytes: int = 8 << 20, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, distance, item_bytes, similarity, start, end): one row for each pair, at its best place (bytes)."""
    rows = docs.select(doc, text)
    kind, item_kind = rows.schema[doc].dataType, benchmark.schema[item].dataType
    schema = f"`{doc}` {kind.simpleString()}, `{item}` {item_kind.simpleString()}, distance int, item_bytes int, similarity double, start bigint, end bigint"
    shared = [docs.sparkSession.sparkContext.broadcast(part) for part in slices(benchmark, similarity, least, slice_bytes, item, item_text)]
    if not shared:
        return docs.sparkSession.createDataFrame([], schema)
    named = [[(i, len(x)) for i, x in part.value.rows] for part in shared]

    def run(batches):
        for batch, found in searched(batches, shared, 1):
            ids = batch.column(0).to_pylist()
            got = [(i, *named[n][item], d, a, b) for i, f in zip(ids, found, strict=True) for n, item, d, a, b in f]
            columns = ([g[0] for g in got], [g[1] for g in got], [g[3] for g in got], [g[2] for g in got], [1 - g[3] / g[2] for g in got], [g[4] for g in got], [g[5] for g in got])
            kinds = (to_arrow_type(kind), to_arrow_type(item_kind), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[doc, item, "distance", "item_bytes", "similarity", "start", "end"])

    return per_batch(rows, run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least: int = 32, slice_bytes: int = 8 << 20, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows in which an item is found; nothing is shuffled."""
    at = docs.columns.index(text)
    shared = [docs.sparkSession.sparkContext.broadcast(part) for part in slices(benchmark, similarity, least, slice_bytes, item, item_text)]

    def run(batches):
        for batch, found in searched(batches, shared, at):
            yield batch.filter(pa.array([not f for f in found], pa.bool_()))

    return per_batch(docs, run, docs.schema) if shared else docs
