"""Range coding of id sequences with mixed order-0 to order-2 predictions, many independent blocks at once.

A block's ids are numbered in the order in which they first occur; the list of them stands before the code. Each number is then
coded as one of three events: what followed the last two numbers the last time, what followed the last one, or a number by its
frequency, with room for those not listed yet. The shares of the events, for each state of confidence of the two predictions, and
the frequencies are learnt from what was coded before, at fixed steps. Blocks know nothing of each other, so a task codes them side
by side, one number of each block in one step. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np

#: Entries of the order-2 table of a block.
PAIRS = 4096
#: Ids of a block at most; parts into which the frequencies of a block divide. Every listed number has one part or more.
BLOCK_IDS, PARTS = 4096, 8192
#: Shares and frequencies are learnt after these steps and then every EVERY.
FIRST, EVERY = (16, 48, 128, 256), 512
_LOW, _WORD, _WHOLE = np.uint64(1 << 48), np.uint64(16), 1 << 32


class _Model:
    """State of `lanes` blocks, the longest first; a step takes the first m of them. Contexts and table entries are numbers + 1; entries also hold, in two bits, how often they were right in turn. Nothing depends on the other blocks of a step."""

    def __init__(self, lanes: int, distinct: int, lookup: bool):
        lane = np.arange(lanes, dtype=np.int64)
        self.width, self.lookup = distinct + 1, lookup
        self.one, self.two = np.zeros(lanes * (distinct + 2), np.int32), np.zeros(lanes * PAIRS, np.int32)
        self.at_one, self.at_two, self.at_state, self.at_freq, self.at_part = lane * (distinct + 2), lane * PAIRS, lane * 32, lane * self.width, lane * PARTS
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        state = np.arange(32)
        self.known2, self.known1 = (state >> 2 & 3) > 0, ((state & 3) > 0) & (state < 16)
        #: Times of each event in each state, from a start of a few.
        self.events = np.tile(np.array([1, 1, 2], np.int64), (lanes, 32, 1))
        self.counts, self.seen = np.zeros((lanes, distinct), np.int32), np.zeros(lanes, np.int64)
        self.listed = np.zeros(lanes, np.int64)
        self.rows: list[tuple] = []
        self._learn(lanes)

    def _learn(self, m: int) -> None:
        """Take in the steps since the last time."""
        for name in ("f2", "both", "scale", "freq", "cum", "new", "at_new"):
            if not hasattr(self, name):
                shape = {"new": len(self.seen), "at_new": len(self.seen), "freq": len(self.seen) * self.width, "cum": len(self.seen) * self.width}.get(name, len(self.seen) * 32)
                setattr(self, name, np.zeros(shape, np.int32 if name in ("freq", "cum") else np.int64))
        if self.lookup and not hasattr(self, "parts"):
            self.parts = np.zeros(len(self.seen) * PARTS, np.uint16)
        came, news = np.zeros(len(self.seen), np.int64), self.seen - self.listed
        if self.rows:
            state, kind = np.concatenate([r[0] for r in self.rows]), np.concatenate([r[1] for r in self.rows])
            self.events += np.bincount(state * 3 + kind, minlength=self.events.size).reshape(self.events.shape)
            number = np.concatenate([r[2] for r in self.rows])[kind == 2]
            owner = state[kind == 2] >> 5
            self.counts += np.bincount(owner * self.counts.shape[1] + number, minlength=self.counts.size).reshape(self.counts.shape)
            came = np.bincount(owner, minlength=len(self.seen))
            self.rows = []
        e = self.events[:m]
        h2, h1, rest = e[:, :, 0] * self.known2, e[:, :, 1] * self.known1, e[:, :, 2]
        f2 = np.where(h2, np.minimum(h2 * 4096 // (h2 + h1 + rest) + 1, 4000), 0) << 20
        left = _WHOLE - f2
        f1 = np.where(h1, np.minimum(h1 * 4096 // (h1 + rest) + 1, 4000), 0) * (left >> 12)
        self.f2[: m * 32], self.both[: m * 32], self.scale[: m * 32] = f2.reshape(-1), (f2 + f1).reshape(-1), ((left - f1) // PARTS).reshape(-1)
        listed = self.seen[:m]
        room = np.clip(PARTS * (news[:m] + 1) // (came[:m] + 2), 16, PARTS // 2)
        counts = self.counts[:m]
        room = np.maximum(np.minimum(room, PARTS - listed), 1)
        free = PARTS - listed - room
        freq = np.zeros((m, self.width), np.int32)
        own = freq[:, :-1]
        np.multiply(counts, free.astype(np.int32)[:, None], out=own)
        own //= np.maximum(counts.sum(1, dtype=np.int32), 1)[:, None]
        own += np.arange(own.shape[1], dtype=np.int32) < listed[:, None]
        sums = np.cumsum(freq, 1, dtype=np.int32)
        freq[:, -1] = PARTS - sums[:, -1]
        sums -= freq
        sums[:, -1] = PARTS - freq[:, -1]
        self.freq[: m * self.width], self.cum[: m * self.width] = freq.reshape(-1), sums.reshape(-1)
        self.new[:m], self.at_new[:m] = freq[:, -1], PARTS - freq[:, -1]
        self.listed[:m] = listed
        if self.lookup:
            self.parts[: m * PARTS] = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), m), freq.reshape(-1))

    def predict(self, m: int) -> None:
        last = self.last[:m]
        self.i1 = self.at_one[:m] + last
        self.i2 = self.at_two[:m] + ((last * 40503 + self.before[:m] * 30011) >> 3 & PAIRS - 1)
        self.e1, self.e2 = self.one.take(self.i1), self.two.take(self.i2)
        self.c1, self.c2 = self.e1 & 3, self.e2 & 3
        same = (self.e1 ^ self.e2) < 4
        self.state = self.at_state[:m] + (self.c2 * 4 + self.c1 + same * np.int32(16))
        self.share2, self.edge = self.f2.take(self.state), self.both.take(self.state)

    def update(self, t: int, m: int, symbols: np.ndarray, kind: np.ndarray, who: np.ndarray) -> None:
        """`kind`: 0 and 1 for the predictions, 2 for the others, `who`."""
        after = symbols + 1
        up = after.astype(np.int32)
        base = up << 2
        self.two[self.i2] = base + np.minimum(self.c2 * (kind == 0) + 1, 3)
        self.one[self.i1] = base + np.minimum(self.c1 * (self.e1 >> 2 == up) + 1, 3)
        own = symbols[who]
        self.seen[who] += own == self.seen[who]
        self.before[:m] = self.last[:m]
        self.last[:m] = after
        self.rows.append((self.state, kind, symbols))
        if (t + 1) % EVERY == 0 or t + 1 in FIRST:
            self._learn(m)

    def by_number(self, who: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of numbers within the parts of their blocks, in units of the state's scale; numbers not listed share the room for them."""
        at = self.at_freq[who] + symbols
        scale = self.scale.take(self.state[who])
        start, length = self.cum.take(at) * scale, self.freq.take(at) * scale
        late = np.flatnonzero(symbols >= self.listed[who])
        if len(late):
            lanes = who[late]
            length[late] = self.new[lanes] * scale[late] // (self.seen[lanes] - self.listed[lanes] + 1)
            start[late] = self.at_new[lanes] * scale[late] + length[late] * (symbols[late] - self.listed[lanes])
        return start, length

    def by_place(self, who: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, start, length) of the number that covers `place`."""
        scale = self.scale.take(self.state[who])
        part = np.minimum(place // scale, PARTS - 1)
        number = self.parts.take(self.at_part[who] + part).astype(np.int64)
        at = self.at_freq[who] + number
        start, length = self.cum.take(at) * scale, self.freq.take(at) * scale
        late = np.flatnonzero(number == self.width - 1)
        if len(late):
            lanes = who[late]
            first, many = self.at_new[lanes] * scale[late], self.seen[lanes] - self.listed[lanes] + 1
            length[late] = self.new[lanes] * scale[late] // many
            nth = np.minimum((place[late] - first) // length[late], many - 1)
            start[late] = first + length[late] * nth
            number[late] = self.listed[lanes] + nth
        return number, start, length


def _number(ids: np.ndarray, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in the order in which they first occur, and each id's place in it. `scratch` has room for every id."""
    at = np.arange(len(ids))
    scratch[ids[::-1]] = at[::-1]
    first = scratch[ids]
    fresh = first == at
    return ids[fresh], (np.cumsum(fresh) - 1)[first]


def _longest_first(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order of the blocks, their sizes in it, and how many blocks each step has."""
    if size.max(initial=0) > BLOCK_IDS:
        raise ValueError(f"a block holds {BLOCK_IDS} ids at most")
    order = np.argsort(-size, kind="stable")
    n = size[order]
    return order, n, np.searchsorted(-n, -np.arange(size.max(initial=0)), "left").tolist()


def encode_blocks(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, bytes]]:
    """(distinct ids, code) of each block."""
    if max((int(b.max()) for b in blocks if len(b)), default=0) < 1 << 22:
        scratch = np.zeros(1 << 22, np.int32)
        numbered = [_number(b, scratch) for b in blocks]
    else:  # ids too large to be places: their ranks are
        value, code = np.unique(np.concatenate(blocks), return_inverse=True)
        scratch, ends = np.zeros(len(value), np.int32), np.cumsum([len(b) for b in blocks])[:-1]
        numbered = [(value[v], place) for v, place in (_number(b, scratch) for b in np.split(code, ends))]
    order, n, active = _longest_first(np.fromiter(map(len, blocks), np.int64, len(blocks)))
    symbols = np.zeros((len(active), len(n)), np.int64)
    for lane, i in enumerate(order.tolist()):
        symbols[: n[lane], lane] = numbered[i][1]
    model = _Model(len(n), max((len(v) for v, _ in numbered), default=0), False)
    low, span = np.zeros(len(n), np.uint64), np.full(len(n), 2**64 - 1, np.uint64)
    out, at = np.zeros((len(n), 2048), np.uint16), np.zeros(len(n), np.int64)
    for t, m in enumerate(active):
        if t % 256 == 0 and at.max() + 3 * 256 + 8 > out.shape[1]:
            out = np.concatenate((out, np.zeros_like(out)), 1)
        s = symbols[t, :m]
        model.predict(m)
        hit2 = model.e2 >> 2 == s + 1
        hit1 = (model.e1 >> 2 == s + 1) & ~hit2
        kind = 2 - hit1 - 2 * hit2
        start, length = np.where(hit2, 0, model.share2), np.where(hit2, model.share2, model.edge - model.share2)
        who = np.flatnonzero(kind == 2)
        begin, length[who] = model.by_number(who, s[who])
        start[who] = model.edge[who] + begin
        unit = span[:m] >> np.uint64(32)
        moved = low[:m] + unit * start.view(np.uint64)
        carried = np.flatnonzero(moved < low[:m])
        back = at[carried] - 1
        while len(carried):
            out[carried, back] += 1
            full = out[carried, back] == 0
            carried, back = carried[full], back[full] - 1
        low[:m] = moved
        span[:m] = unit * length.view(np.uint64)
        while len(small := np.flatnonzero(span[:m] < _LOW)):
            out[small, at[small]] = low[small] >> np.uint64(48)
            at[small] += 1
            low[small] <<= _WORD
            span[small] <<= _WORD
        model.update(t, m, s, kind, who)
    made: list = [None] * len(blocks)
    for lane, i in enumerate(order.tolist()):
        rest = [int(low[lane]) >> b & 0xFFFF for b in (48, 32, 16, 0)]
        made[i] = (numbered[i][0], out[lane, : at[lane]].astype("<u2").tobytes() + np.array(rest, "<u2").tobytes())
    return made


def decode_blocks(coded: list[tuple[int, np.ndarray, bytes]]) -> list[np.ndarray]:
    """The ids of each block, from their number, the distinct ids and the code."""
    order, n, active = _longest_first(np.array([c[0] for c in coded], np.int64))
    words = np.zeros((len(n), max((len(c[2]) for c in coded), default=0) // 2 + 8), np.uint64)
    for lane, i in enumerate(order.tolist()):
        w = np.frombuffer(coded[i][2], "<u2")
        words[lane, : len(w)] = w
    model = _Model(len(n), max((len(c[1]) for c in coded), default=0), True)
    span, at = np.full(len(n), 2**64 - 1, np.uint64), np.full(len(n), 4, np.int64)
    code = words[:, 0] << np.uint64(48) | words[:, 1] << np.uint64(32) | words[:, 2] << np.uint64(16) | words[:, 3]
    symbols = np.zeros((len(active), len(n)), np.int64)
    for t, m in enumerate(active):
        model.predict(m)
        unit = span[:m] >> np.uint64(32)
        v = (code[:m] // unit).view(np.int64)
        hit2 = v < model.share2
        kind = (v >= model.share2).astype(np.int64) + (v >= model.edge)
        s = (np.where(hit2, model.e2, model.e1) >> 2).astype(np.int64)
        s -= 1
        start, length = np.where(hit2, 0, model.share2), np.where(hit2, model.share2, model.edge - model.share2)
        who = np.flatnonzero(kind == 2)
        s[who], begin, length[who] = model.by_place(who, v[who] - model.edge[who])
        start[who] = model.edge[who] + begin
        code[:m] -= unit * start.view(np.uint64)
        span[:m] = unit * length.view(np.uint64)
        while len(small := np.flatnonzero(span[:m] < _LOW)):
            code[small] = code[small] << _WORD | words[small, np.minimum(at[small], words.shape[1] - 1)]
            at[small] += 1
            span[small] <<= _WORD
        symbols[t, :m] = s
        model.update(t, m, s, kind, who)
    made: list = [None] * len(coded)
    for lane, i in enumerate(order.tolist()):
        made[i] = coded[i][1][symbols[: n[lane], lane]] if n[lane] else np.zeros(0, np.uint32)
    return made
