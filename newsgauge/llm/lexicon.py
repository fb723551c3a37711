"""A minimal acyclic transducer from words to token ids, in one file that tasks memory-map.

Words are inserted in order and states with equal continuations are shared as soon as no later word can
change them, so the automaton is minimal. Every arc carries a number; their sum along a word is the
word's place among all words, and the place leads to its ids. Lookup walks all given words side by side.
"""

from __future__ import annotations

import numpy as np


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for words and their ids."""
    words = sorted(entries)
    shared: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in shared:
            shared[key] = len(states)
            states.append(key)
        return shared[key]

    # path: for each byte of the last word, the open state it leads from: [final, [(byte, state)]]
    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for k in range(len(last), common, -1):
            node = path.pop()
            path[-1][1].append((last[k - 1], freeze(node)))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[k - 1], freeze(node)))
    root = freeze(path[0])

    used = sorted({b for _, arcs in states for b, _ in arcs})
    classes = np.full(256, len(used), np.uint8)  # the last class leads nowhere
    classes[used] = np.arange(len(used))
    target = np.full((len(states), len(used) + 1), -1, np.int32)
    number = np.zeros((len(states), len(used) + 1), np.int32)
    final = np.zeros(len(states), np.uint8)
    accepted: list[int] = []
    for state, (ends, arcs) in enumerate(states):  # targets come before their sources
        total = int(ends)
        final[state] = ends
        for byte, to in arcs:
            target[state, classes[byte]] = to
            number[state, classes[byte]] = total
            total += accepted[to]
        accepted.append(total)
    ids = [entries[w] for w in words]
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    flat = np.array([i for x in ids for i in x], np.int32)
    head = np.array([len(states), len(used) + 1, len(words), len(flat), root], np.int64)
    return b"".join(x.tobytes() for x in (head, offsets, target, number, flat, classes, final))


class Lexicon:
    """Reads what ``build`` wrote; the file is mapped, not loaded."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        states, width, words, ids, self.root = (int(x) for x in raw[:40].view(np.int64))
        at = 40

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            part, at = raw[at:at + size].view(kind), at + size
            return part

        self.width = width
        self.offsets = take(np.int64, words + 1)
        self.target, self.number = take(np.int32, states * width), take(np.int32, states * width)
        self.ids = take(np.int32, ids)
        self.classes, self.final = take(np.uint8, 256), take(np.uint8, states)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, -1 if it is not in the lexicon."""
        size = np.array([len(w) for w in words], np.int64)
        data = self.classes[np.frombuffer(b"".join(words), np.uint8)]
        start = np.cumsum(size) - size
        state = np.full(len(words), self.root, np.int64)
        place = np.zeros(len(words), np.int64)
        step, live = 0, np.flatnonzero(size > 0)
        while len(live):
            arc = state[live] * self.width + data[start[live] + step]
            place[live] += self.number[arc]
            state[live] = to = self.target[arc]
            step += 1
            live = live[(to >= 0) & (size[live] > step)]
        known = state >= 0
        known[known] = self.final[state[known]] == 1
        return np.where(known, place, -1)
