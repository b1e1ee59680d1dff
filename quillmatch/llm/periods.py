"""Runs of repeated words by Crochemore's partition refinement.

Level by level, places with equal factors of that many words form classes. From one level to the next a class is split by the
classes of its places' successors; of the parts that a class falls into, the largest keeps its name, so only places of
the others (the smaller halves) have to look at their predecessors. Members of a class are linked in order of place. At level
q, neighbours q words apart mark a square of period q, and squares at consecutive places merge into a run.

A run has at least POWER times its period here, so all its squares lie in classes of MEMBERS = POWER - 1 places at least, up to the level of
its period. Smaller classes are dead, and so is, one level on, a place before a dead one. In plain prose that leaves nearly nothing after
a few levels. A document is done at a quarter of its words, the longest period that can matter.

A neighbour at distance q at level q has a primitive root: a shorter repetition inside it would put another member between.
So periods are the smallest ones.

All documents of a slice are refined at once in NumPy: what a level costs beside its moved places is shared by them. Slices hold about
SLICE bytes of text, or one document.

Defined results: null and empty texts have no words and no run; a null doc_id is taken as it is, without the repetition that the
contract lays on some ids; repeated rows each get a row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytescan import pieces
from .common import table

#: A run has at least LEAST words, and POWER times its period.
LEAST, POWER = 6, 4
#: A factor as long as a run's period comes so many times in the run at least.
MEMBERS = POWER - 1
#: Up to this level all places are looked at; from there on changes only.
DIRECT = 3
SLICE = 8_000_000


class Agenda:
    """Pairs of a level and a place, given out level by level: a radix heap, for levels only rise."""

    def __init__(self, now: int):
        self.now, self.held = now, {}

    def add(self, level: np.ndarray, place: np.ndarray) -> None:
        """Levels are those of now, or later."""
        if not len(level):
            return
        bits = np.frexp((level ^ self.now).astype(np.float64))[1]
        for b in np.unique(bits) if len(bits) > 1 else bits:
            mine = bits == b
            self.held.setdefault(int(b), []).append((level[mine], place[mine]))

    def step(self) -> np.ndarray:
        """The places of the next level."""
        self.held.pop(0, None)
        bit = (self.now ^ (self.now + 1)).bit_length()
        self.now += 1
        for level, place in self.held.pop(bit, ()):
            self.add(level, place)
        here = self.held.get(0, [])
        return np.concatenate([p for _, p in here]) if here else np.zeros(0, np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each of the sizes."""
    return np.repeat(first - _starts(sizes), sizes) + np.arange(sizes.sum())


class Refinement:
    """Classes of places of some documents at one level. Between documents lies a place that no class holds."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        """words: a number for each word of one document after the other; bounds: where they start, and the end."""
        size = np.diff(bounds)
        documents, n = len(size), len(words) + len(size)
        self.end, self.level = n, 1
        doc = np.repeat(np.arange(documents), size)
        place = np.arange(len(words)) + doc
        #: the greatest level that matters for each place
        self.limit = np.repeat(size // POWER, size + 1)
        self.name = np.full(n, -1, np.int64)
        self.next, self.before = np.full(n + 1, n, np.int64), np.full(n + 1, n, np.int64)
        key = doc * (int(words.max(initial=0)) + 1) + words
        by = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1])) if len(by) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, len(by)))
        alive = sizes >= MEMBERS
        inside = np.repeat(alive, sizes)
        self.order = place[by][inside]
        self.size, self.start = self._room(sizes[alive]), self._room(_starts(sizes[alive]))
        self.count = int(alive.sum())
        self.name[self.order] = np.repeat(np.arange(self.count), sizes[alive])
        self.at = np.zeros(n, np.int64)
        self.at[self.order] = np.arange(len(self.order))
        self._link(self.order, self.name[self.order])
        self.moved = np.arange(n)
        self.agenda = Agenda(DIRECT)

    def _room(self, values: np.ndarray) -> np.ndarray:
        """Classes are made by parting from one that keeps MEMBERS places, so there are never more than this."""
        out = np.zeros(len(self.name) // MEMBERS + 2, np.int64)
        out[: len(values)] = values
        return out

    def _link(self, places: np.ndarray, names: np.ndarray) -> None:
        """places: in order, class by class."""
        if not len(places):
            return
        same = names[1:] == names[:-1]
        self.next[places] = np.append(np.where(same, places[1:], self.end), self.end)
        self.before[places] = np.append(self.end, np.where(same, places[:-1], self.end))

    def squares(self) -> np.ndarray:
        """Places at which a square of the level's period starts."""
        q = self.level
        if q <= DIRECT:
            live = np.flatnonzero((self.name >= 0) & (self.limit >= q))  # documents that are done keep classes of an earlier level
            found = live[self.next[live] == live + q]
            if q == DIRECT:
                self._expect(live)
            return found
        due = self.agenda.step()
        return np.unique(due[(self.name[due] >= 0) & (self.next[due] == due + q)])

    def _expect(self, places: np.ndarray) -> None:
        gap = self.next[places] - places
        fits = (self.next[places] < self.end) & (gap > self.level) & (gap <= self.limit[places])
        self.agenda.add(gap[fits], places[fits])

    def refine(self) -> bool:
        """On to the next level; False once no place is left that could matter."""
        onto, self.level = self.moved, self.level + 1
        self.moved = np.zeros(0, np.int64)
        place = onto - 1
        fine = self.name[place] >= 0
        place, onto = place[fine], onto[fine]
        fine = self.limit[place] >= self.level
        place, onto = place[fine], onto[fine]
        if not len(place):
            return False
        # groups of places of one class whose successors are of one class
        mine, theirs = self.name[place], self.name[onto]
        by = np.lexsort((place, theirs, mine))
        place, mine, theirs = place[by], mine[by], theirs[by]
        new_class = np.append(True, mine[1:] != mine[:-1])
        new_group = new_class.copy()
        new_group[1:] |= theirs[1:] != theirs[:-1]
        at = np.flatnonzero(new_group)
        group_size = np.diff(np.append(at, len(place)))
        group_alive = (theirs[at] >= 0) & (group_size >= MEMBERS)
        first = np.flatnonzero(new_class[at])
        group_class = np.cumsum(new_class[at]) - 1
        names = mine[at[first]]
        touched = np.add.reduceat(group_size, first)
        rest = self.size[names] - touched
        # the largest part of each class keeps its name: the untouched rest, or a group
        alive_size = np.where(group_alive, group_size, 0)
        best = np.maximum.reduceat(alive_size, first)
        stays = (rest >= best) & (rest >= MEMBERS)
        top = (alive_size == best[group_class]) & (alive_size > 0) & ~stays[group_class]
        top_at = np.flatnonzero(top)
        top_at = top_at[np.append(True, group_class[top_at][1:] != group_class[top_at][:-1])] if len(top_at) else top_at
        keeps = np.zeros(len(at), bool)
        keeps[top_at] = True
        goes = np.repeat(~keeps, group_size)
        # where the rest does not stay, its places are read from the class's stretch of the order: no more than are touched
        part = ~stays & (rest > 0)
        place_group = np.repeat(np.arange(len(at)), group_size)
        moved, group = place[goes], place_group[goes]
        if part.any():
            whole = self.order[_spread(self.start[names[part]], self.size[names[part]])]
            owner = np.repeat(np.flatnonzero(part), self.size[names[part]])
            hit = np.zeros(self.end, bool) if len(whole) > self.end // 64 else None
            if hit is not None:
                hit[place] = True
                left = ~hit[whole]
            else:
                left = ~np.isin(whole, place)
            # the rest of class k is group len(at) + k
            moved, group = np.append(moved, whole[left]), np.append(group, len(at) + owner[left])
        if not len(moved):
            return True
        of = np.append(group_class, np.arange(len(names)))
        all_alive = np.append(group_alive, rest >= MEMBERS)
        by = np.lexsort((moved, group, of[group]))
        moved, group = moved[by], group[by]
        self._part(moved, group, names[of[group]], all_alive)
        self.moved = moved
        return True

    def _part(self, moved: np.ndarray, group: np.ndarray, old: np.ndarray, alive: np.ndarray) -> None:
        """Takes the places out of their old classes, group by group; groups that live become classes."""
        # out of the links: what was removed in a row is bridged
        by = np.lexsort((moved, old))
        row = moved[by]
        head = np.append(True, self.before[row[1:]] != row[:-1])
        tail = np.append(self.next[row[:-1]] != row[1:], True)
        left, right = self.before[row[head]], self.next[row[tail]]
        self.next[left], self.before[right] = right, left
        # out of the order: to the end of the class's stretch
        at = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        names, sizes = old[at], np.diff(np.append(at, len(old)))
        self.size[names] -= sizes
        slots = _spread(self.start[names] + self.size[names], sizes)
        where = self.at[moved]
        edge = np.repeat(self.start[names] + self.size[names], sizes)
        free = where[where < edge]  # class by class, as the stretch ends are
        self.at[moved] = -1
        held = self.order[slots]
        stay = held[self.at[held] >= 0]
        self.order[free], self.at[stay] = stay, free
        self.order[slots], self.at[moved] = moved, slots
        # new names
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes, live = np.diff(np.append(at, len(group))), alive[group[at]]
        number = int(live.sum())
        name = np.full(len(at), -1, np.int64)
        name[live] = np.arange(self.count, self.count + number)
        self.size[self.count : self.count + number], self.start[self.count : self.count + number] = sizes[live], slots[at[live]]
        self.count += number
        self.name[moved] = np.repeat(name, sizes)
        lives = np.repeat(live, sizes)
        kept = moved[lives]
        self._link(kept, self.name[kept])
        if self.level > DIRECT:
            self._expect_from(np.concatenate([left[left < self.end], kept]))

    def _expect_from(self, places: np.ndarray) -> None:
        """Places whose neighbour is another one than before; the level's own are still to be asked for."""
        gap = self.next[places] - places
        fits = (self.next[places] < self.end) & (gap >= self.level) & (gap <= self.limit[places])
        self.agenda.add(gap[fits], places[fits])


def runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start within it, length and period of every run, by document, start and period."""
    state, found = Refinement(words, bounds), []
    while True:
        i = state.squares()
        if len(i):
            cut = np.flatnonzero(np.append(True, np.diff(i) > 1))
            first, last = i[cut], i[np.append(cut[1:], len(i)) - 1]
            length = last - first + 2 * state.level
            long = length >= max(LEAST, POWER * state.level)
            found.append(np.stack([first[long], length[long], np.full(long.sum(), state.level)]))
        if not state.refine():
            break
    first, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    opens = bounds[:-1] + np.arange(len(bounds) - 1)
    doc = np.searchsorted(opens, first, "right") - 1
    by = np.lexsort((period, first))
    return doc[by], (first - opens[doc])[by], length[by], period[by]


def repetition(doc_id: int | None, n: int) -> np.ndarray | None:
    """For each word, which original one stands there, where the contract lays a repetition on the document."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(ids: list, texts: list[str | None]) -> list[tuple]:
    split = [(x or "").encode("utf-8", "replace").split() for x in texts]  # bytes are split at ASCII white space only
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in split])])
    flat = [w for x in split for w in x]
    words = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    laid = {}
    for k, doc_id in enumerate(ids):
        source = repetition(doc_id, len(split[k]))
        if source is not None:
            words[bounds[k] : bounds[k + 1]] = words[bounds[k] + source]
            laid[k] = source
    doc, start, length, period = runs(words, bounds)
    # a run drops its words after the first period: marks of where that begins and ends, summed up
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, bounds[doc] + start + period, 1)
    np.add.at(marks, bounds[doc] + start + length, -1)
    dropped = np.cumsum(marks)[:-1] > 0
    begin = np.searchsorted(doc, np.arange(len(ids) + 1))
    out = []
    for k, own in enumerate(split):
        a, b = begin[k], begin[k + 1]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        if k in laid:
            own = [own[j] for j in laid[k].tolist()]
        if b > a:
            own = [w for w, gone in zip(own, dropped[bounds[k] : bounds[k + 1]].tolist(), strict=True) if not gone]
        best = min(range(a, b), key=lambda j: (-length[j], start[j], period[j]), default=None)
        longest = (None,) * 4 if best is None else (int(start[best]), int(length[best]), int(period[best]), int(1000 * length[best] // period[best]))
        out.append((int(b - a), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest()))
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to one row for each: its number of runs, the longest one, and digests of all runs and of the words that are kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
        for whole in batches:
            for batch in pieces(whole, "text", SLICE):
                rows = _digests(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *schema.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op13_periods(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
