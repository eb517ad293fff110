"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block is coded by itself from a fresh model, so any block can be read alone, and numpy codes the
n-th id of all blocks of a group (the lanes) at once. For each id:

* order 2 and order 1 each predict one id: what last followed the hashed last two ids, and the last id;
* order 0 predicts the ids that the block has had, all alike;
* an event says which order holds, the highest that does, or that the id is new to the block. Its odds
  mix two adaptive models by adding their counts: one by the confidence of both predictions and whether
  they agree, one by the last two events;
* an id of order 0 is one of as many as were seen; a new one goes out as one or two 16-bit numbers.

Four counts of 16 bits make one number, so a sum of models and their cumulative counts are one addition
and one product. The coder's window has 48 bits, exact in doubles; words of 24 bits go out, each with
room for a carry, which is passed back at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

try:
    from pandas._libs.groupby import group_shift_indexer
except ImportError:  # not a public name; a sort does the same at five times the cost
    group_shift_indexer = None

#: Bits of the tables that predict by order 1 and order 2; ids must be below NONE.
SLOTS_1, SLOTS_2, NONE = 9, 10, 0x7FFFFFFF
#: Ids of a block at most.
MOST = 4096
_FIELD, _SUMS, _HALVES = np.uint64(0xFFFF), np.uint64(0x0001_0001_0001_0001), np.uint64(0x7FFF_7FFF_7FFF_7FFF)
_S16, _S32, _S48 = np.uint64(16), np.uint64(32), np.uint64(48)
#: Added to the count of an event, sum of a row's counts that is halved, steps between looks at it; blocks looked at together.
_STEP, _FULL, _EVERY, _TOGETHER = 16, 700, 16, 64
#: Added to the length of rows that are gone through side by side: at multiples of a page they would share the cache's lines.
_PAD = 16
_ADD = np.asarray([_STEP << (16 * e) for e in range(4)], dtype=np.uint64)
_START = np.uint64(0x0004_0008_0001_0001)
_WORD, _RAW = float(1 << 24), 65536.0


class _Model:
    """What encoder and decoder share: the predictions and counts of every lane."""

    def __init__(self, lanes: int, guesses: bool = True) -> None:
        at = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2 = at << SLOTS_1, at << SLOTS_2
        self.guess1, self.guess2 = (np.full(lanes << bits if guesses else 0, NONE, dtype=np.uint32) for bits in (SLOTS_1, SLOTS_2))
        self.base_sure, self.base_past = at * 8, at * 16
        self.sure, self.past_counts = np.full(lanes * 8, _START), np.full(lanes * 16, _START)
        self.at1, self.at2, self.past = self.base1.copy(), self.base2.copy(), np.zeros(lanes, dtype=np.int64)
        self.before = np.zeros(lanes, dtype=np.uint32)
        self.steps = 0

    def cut(self, n: int) -> None:
        """Only the first n lanes go on."""
        for name in ("base1", "base2", "base_sure", "base_past", "at1", "at2", "past", "before"):
            setattr(self, name, getattr(self, name)[:n])

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id by order 1, id by order 2, the four counts of the events)."""
        x1, x2 = self.guess1.take(self.at1), self.guess2.take(self.at2)
        p1, p2 = x1 & NONE, x2 & NONE
        self.row = self.base_sure + ((x1 >> 31) | ((x2 >> 30) & 2) | ((p1 == p2).view(np.uint8) * np.uint32(4)))
        self.row_past = self.base_past + self.past
        self.own, self.own_past = self.sure.take(self.row), self.past_counts.take(self.row_past)
        return p1, p2, self.own + self.own_past

    def learn(self, now: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, event: np.ndarray) -> None:
        add = _ADD.take(event)
        self.sure[self.row] = self.own + add
        self.past_counts[self.row_past] = self.own_past + add
        self.past = ((self.past << 2) & 15) + event
        self.guess1[self.at1] = now | (hit1.astype(np.uint32) << 31)
        self.guess2[self.at2] = now | (hit2.astype(np.uint32) << 31)
        h = now * 2654435761
        self.at1 = self.base1 + (h >> (32 - SLOTS_1))
        self.at2 = self.base2 + ((h + self.before) >> (32 - SLOTS_2))
        self.before = now * 2246822519
        self.steps += 1
        if self.steps % _EVERY == 0:
            self.halve()

    def count(self, rows: np.ndarray, rows_past: np.ndarray, event: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The four counts at each of some steps whose events are known; live: lanes that have the step."""
        add, out = _ADD.take(event), np.full(rows.shape, _START)
        for t, n in enumerate(live.tolist()):
            row, row_past = rows[t, :n], rows_past[t, :n]
            own, own_past = self.sure.take(row), self.past_counts.take(row_past)
            np.add(own, own_past, out=out[t, :n])
            self.sure[row] = own + add[t, :n]
            self.past_counts[row_past] = own_past + add[t, :n]
        if len(live) == _EVERY:
            self.halve()
        return out

    def halve(self) -> None:
        for table in (self.sure, self.past_counts):
            full = np.flatnonzero((table * _SUMS) >> _S48 > _FULL)
            table[full] = ((table[full] >> np.uint64(1)) & _HALVES) | _SUMS


def _live(size: np.ndarray, most: int) -> np.ndarray:
    """How many of the lanes, longest first, have an n-th id."""
    return np.searchsorted(-size, -np.arange(most), side="left")


def _last(slot: np.ndarray, slots: int) -> np.ndarray:
    """The last step before each that had its slot; -1 if none had."""
    if group_shift_indexer is not None:
        last = np.empty(len(slot), dtype=np.int64)
        group_shift_indexer(last, slot.astype(np.intp), slots, 1)
        return last
    order = np.argsort(slot, kind="stable")
    same = slot[order[1:]] == slot[order[:-1]]
    last = np.full(len(slot), -1, dtype=np.int64)
    last[order[1:][same]] = order[:-1][same]
    return last


def _followed(slot: np.ndarray, slots: int, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a table that keeps the last id of each slot says at each step: (id, 1 where it holds, 1 where the slot's last did)."""
    last = _last(slot, slots)
    guess = np.append(now, np.uint32(NONE)).take(last, mode="wrap")
    hit = np.zeros(len(now) + 1, dtype=np.uint8)
    np.equal(guess, now, out=hit[:-1].view(bool))
    return guess, hit[:-1], hit.take(last, mode="wrap")


def _told(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a model tells of a block when all its ids are known: (row of sure + 8 * past + 128 * event + 512 * seen, number that is coded).

    The number is an id's place in the block's list (event 2) or a new id (event 3).
    """
    h = now * np.uint32(2654435761)
    slot1, slot2 = np.zeros((2, len(now)), dtype=np.uint32)
    slot1[1:] = h[:-1] >> np.uint32(32 - SLOTS_1)
    h[1:] += now[:-1] * np.uint32(2246822519)
    slot2[1:] = h[:-1] >> np.uint32(32 - SLOTS_2)
    (p1, is1, sure1), (p2, is2, sure2) = _followed(slot1, 1 << SLOTS_1, now), _followed(slot2, 1 << SLOTS_2, now)
    number = pd.factorize(now)[0].astype(np.uint32)  # by first appearance: the place in the block's list
    seen = np.zeros(len(now), dtype=np.uint32)
    np.maximum.accumulate(number[:-1], out=seen[1:])
    seen[1:] += np.uint32(1)
    new = number == seen
    event = ((new.view(np.uint8) | 2) * (is1 ^ 1) | is1) * (is2 ^ 1)
    row = sure1 | sure2 << 1 | (p1 == p2).view(np.uint8) << 2 | event << 7
    row[1:] |= event[:-1] << 3
    row[2:] |= event[:-2] << 5
    told = seen << np.uint32(9) | row
    told += (event >> 1).astype(np.uint32) << np.uint32(8)
    np.copyto(number, now, where=new)
    return told, number


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Code words of each block of at most MOST ids below NONE, each block from a fresh model."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    size = np.asarray([len(blocks[k]) for k in order], dtype=np.int64)
    lanes, most = len(order), int(size.max(initial=0))
    if most > MOST:
        raise ValueError(f"blocks have at most {MOST} ids")
    told, number = np.zeros((2, most, lanes), dtype=np.uint32)
    wide = np.zeros(lanes, dtype=bool)
    for a in range(0, lanes, _TOGETHER):
        some = order[a : a + _TOGETHER]
        rows = np.zeros((2, len(some), most + _PAD), dtype=np.uint32)
        for lane, k in enumerate(some):
            block = np.asarray(blocks[k], dtype=np.uint32)
            top = int(block.max(initial=0))
            if top >= NONE:
                raise ValueError(f"ids must be below {NONE}")
            wide[a + lane] = top > 0xFFFF
            rows[0, lane, : len(block)], rows[1, lane, : len(block)] = _told(block)
        told[:, a : a + len(some)], number[:, a : a + len(some)] = rows[0, :, :most].T, rows[1, :, :most].T
    model = _Model(lanes, guesses=False)
    low, width = np.zeros(lanes), np.full(lanes, _WORD * _WORD)
    cap = 1024 + _PAD
    out, used = np.zeros((lanes, cap), dtype=np.uint32), np.zeros(lanes, dtype=np.int64)
    row = np.arange(lanes, dtype=np.int64)

    def emit(low: np.ndarray, width: np.ndarray, used: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        small = (width < _WORD).astype(np.float64)
        word = np.floor(low * (1 / _WORD))
        flat[row * cap + used] = word  # stands only if used moves on
        scale = small * (_WORD - 1) + 1
        return (low - word * (small * _WORD)) * scale, width * scale, used + small.astype(np.int64)

    ends, live = [], _live(size, most)
    flat = out.reshape(-1)
    for t0 in range(0, most, _EVERY):  # the counts of some steps, then their code
        n = int(live[t0])
        if n < len(low):
            ends.append((low[n:], used[n:]))
            low, width, used, row = low[:n], width[:n], used[:n], row[:n]
            model.cut(n)
        if int(used.max()) + 3 * _EVERY > cap:
            out = np.concatenate([out, np.zeros((lanes, 1024), dtype=np.uint32)], axis=1)
            cap, flat = cap + 1024, out.reshape(-1)
        steps = slice(t0, min(t0 + _EVERY, most))
        these = told[steps, :n]
        event = (these >> 7) & 3
        counts = model.count((these & 7) + model.base_sure, ((these >> 3) & 15) + model.base_past, event, live[steps])
        old = event == 2
        upto, shift = counts * _SUMS, event.astype(np.uint64) << np.uint64(4)
        total = (upto >> _S48).astype(np.float64)
        below = (((upto << _S16) >> shift) & _FIELD).astype(np.float64)
        share = ((counts >> shift) & _FIELD).astype(np.float64)
        parts, place = np.where(old, these >> 9, 1).astype(np.float64), (number[steps, :n] * old).astype(np.float64)
        new = event == 3
        for t in range(len(these)):
            n = int(live[t0 + t])
            if n < len(low):
                ends.append((low[n:], used[n:]))
                low, width, used, row = low[:n], width[:n], used[:n], row[:n]
                model.cut(n)
            unit = np.floor(width / total[t, :n])
            low = low + unit * below[t, :n]
            width = np.floor(unit * share[t, :n] / parts[t, :n])
            low += width * place[t, :n]
            low, width, used = emit(low, width, used, row)
            who = np.flatnonzero(new[t, :n])
            if len(who):
                now = number[t0 + t].take(who)
                for half in (16, 0):
                    pick = np.flatnonzero(wide[who]) if half else slice(None)
                    some = who[pick]
                    if len(some):
                        unit = np.floor(width[some] / _RAW)
                        low[some], width[some], used[some] = emit(low[some] + unit * ((now[pick] >> half) & 0xFFFF), unit, used[some], row[some])
    ends.append((low, used))
    low, used = (np.concatenate([e[k] for e in ends[::-1]]) for k in (0, 1))
    done: list[bytes] = [b""] * lanes
    for lane, k in enumerate(order):
        top = np.floor(low[lane] / _WORD)
        words = np.append(out[lane, : used[lane]], [top, low[lane] - top * _WORD]).astype(np.int64)
        carry = np.flatnonzero(words >> 24)
        while len(carry):  # a carry goes one word back, seldom further
            words[carry] &= 0xFFFFFF
            words[carry - 1] += 1
            carry = carry[words[carry - 1] >> 24 > 0] - 1
        done[k] = (b"\1" if wide[lane] else b"\0") + words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return done


def decode(words: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks of ids: the reverse of encode. Damaged words give other ids, or ValueError."""
    order = sorted(range(len(words)), key=lambda k: -sizes[k])
    size = np.asarray([sizes[k] for k in order], dtype=np.int64)
    lanes, most = len(order), int(size.max(initial=0))
    if most > MOST or any(len(w) % 3 != 1 for w in words):
        raise ValueError("not a block")
    wide = np.asarray([words[k][:1] == b"\1" for k in order], dtype=bool)
    n_words = np.asarray([len(words[k]) // 3 for k in order], dtype=np.int64)
    packed = np.frombuffer(b"".join(words[k][1:] for k in order) + bytes(9), dtype=np.uint8).reshape(-1, 3)
    flat = np.zeros((len(packed), 4), dtype=np.uint8)
    flat[:, :3] = packed
    flat = flat.reshape(-1).view("<u4")
    at = np.cumsum(n_words) - n_words
    last = len(flat) - 1
    model, seen = _Model(lanes), np.zeros(lanes)
    code, width, at = flat[at] * _WORD + flat[at + 1], np.full(lanes, _WORD * _WORD), at + 2
    ids, listed = np.zeros((most, lanes), dtype=np.uint32), np.zeros(lanes * (MOST + _PAD), dtype=np.uint32)
    base = np.arange(lanes, dtype=np.int64) * (MOST + _PAD)

    def refill(code: np.ndarray, width: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        small = (width < _WORD).astype(np.float64)
        scale = small * (_WORD - 1) + 1
        return code * scale + small * flat[np.minimum(at, last)], width * scale, at + small.astype(np.int64)

    live = _live(size, most)
    for t in range(most):
        n = int(live[t])
        if n < len(code):
            code, width, at, seen, base = code[:n], width[:n], at[:n], seen[:n], base[:n]
            model.cut(n)
        p1, p2, counts = model.predict()
        upto = counts * _SUMS
        unit = np.floor(width / (upto >> _S48).astype(np.float64))
        b0, b1, b2 = (unit * ((upto >> s) & _FIELD).astype(np.float64) for s in (np.uint64(0), _S16, _S32))
        g0, g1, g2 = ((code >= b).view(np.uint8) for b in (b0, b1, b2))
        event = g0 + g1 + g2
        shift = event.astype(np.uint64) << np.uint64(4)
        code = code - unit * (((upto << _S16) >> shift) & _FIELD).astype(np.float64)
        width = unit * ((counts >> shift) & _FIELD).astype(np.float64)
        old = (event == 2).astype(np.float64)
        width = np.floor(width / np.maximum((seen - 1) * old + 1, 1.0))
        place = np.floor(code / width) * old
        code = code - width * place
        code, width, at = refill(code, width, at)
        # Products of 0 and 1 choose: unsigned numbers wrap, so that a + (b - a) is b.
        now = p2 + (p1 - p2) * g0
        now += (listed[base + np.minimum(place, MOST - 1).astype(np.int64)] - now) * (event == 2)
        who = np.flatnonzero(g2)
        if len(who):
            value = np.zeros(len(who))
            for half in (16, 0):
                pick = np.flatnonzero(wide[who]) if half else np.arange(len(who))
                if len(pick):
                    some = who[pick]
                    unit = np.floor(width[some] / _RAW)
                    digit = np.minimum(np.floor(code[some] / unit), _RAW - 1)
                    code[some], width[some], at[some] = refill(code[some] - unit * digit, unit, at[some])
                    value[pick] = value[pick] * _RAW + digit
            now[who] = value.astype(np.uint32)
            listed[base[who] + np.minimum(seen[who], MOST - 1).astype(np.int64)] = now[who]
            seen[who] += 1
        ids[t, :n] = now
        model.learn(now, p1 == now, p2 == now, event)
    done: list[np.ndarray] = [ids[:0, 0]] * lanes
    for a in range(0, lanes, _TOGETHER):
        rows = np.zeros((min(_TOGETHER, lanes - a), most + _PAD), dtype=np.uint32)
        rows[:, :most] = ids[:, a : a + _TOGETHER].T
        for lane, k in enumerate(order[a : a + _TOGETHER]):
            done[k] = rows[lane, : size[a + lane]]
    return done
