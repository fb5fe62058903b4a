"""A minimal acyclic transducer from words to token ids, kept in one memory-mapped file.

States share suffixes (incremental construction from sorted words), arcs carry whole-number outputs whose sum along a word's
path is the word's place in the sorted list, and that place selects its ids. Look-ups walk all words of a batch at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

ALIGN = 64


def _automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """States (byte -> state) and their acceptance, minimal, of sorted distinct words; state 0 is the start."""
    arcs: list[dict[int, int]] = [{}]
    accepts = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states along the last word
    last = b""

    def settle(depth: int) -> None:
        for at in range(len(path) - 1, depth, -1):
            state, parent, byte = path[at], path[at - 1], last[at - 1]
            key = (accepts[state], tuple(arcs[state].items()))
            known = register.setdefault(key, state)
            if known != state:
                arcs[parent][byte] = known
        del path[depth + 1 :]

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            arcs.append({})
            accepts.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        accepts[path[-1]] = True
        last = word
    settle(0)
    return arcs, accepts


def build(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The arrays of the transducer of words with their ids."""
    words = sorted(entries)
    arcs, accepts = _automaton(words)
    below: dict[int, int] = {}  # words accepted from a state on
    stack, order = [0], []
    seen = {0}
    while stack:  # states in an order in which targets come before sources once reversed
        state = stack[-1]
        todo = [t for t in arcs[state].values() if t not in seen]
        if todo:
            seen.update(todo[:1])
            stack.append(todo[0])
        else:
            order.append(stack.pop())
    for state in order:
        below[state] = accepts[state] + sum(below[t] for t in arcs[state].values())
    number = {state: i for i, state in enumerate(reversed(order))}
    rows = []
    for state in order:
        skipped = int(accepts[state])
        for byte, to in sorted(arcs[state].items()):
            rows.append((number[state] << 8 | byte, number[to], skipped))
            skipped += below[to]
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    lengths = [len(entries[w]) for w in words]
    return {
        "arc": table[:, 0].copy(),
        "target": table[:, 1].astype(np.int32),
        "output": table[:, 2].astype(np.int32),
        "accepts": np.array([accepts[s] for s in reversed(order)], dtype=bool),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for w in words for i in entries[w]], dtype=np.int32),
    }


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: a line that says where each lies, then the arrays, aligned."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // ALIGN) * ALIGN
    head = json.dumps(places).encode()
    head = head.ljust(-(-(len(head) + 1) // ALIGN) * ALIGN - 1) + b"\n"
    return head + b"".join(a.tobytes().ljust(-(-a.nbytes // ALIGN) * ALIGN, b"\0") for a in arrays.values())


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, memory-mapped: processes of one machine share the pages."""
    with open(path, "rb") as f:
        head = f.readline()
    whole = np.memmap(path, dtype=np.uint8, mode="r")
    return {n: whole[len(head) + at : len(head) + at + size * np.dtype(kind).itemsize].view(kind) for n, (kind, size, at) in json.loads(head).items()}


def find(lexicon: dict[str, np.ndarray], words: Iterable[bytes]) -> np.ndarray:
    """The place of each word in the lexicon, -1 where it is not in it; all words advance by one byte at a time."""
    words = list(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    text = np.frombuffer(b"".join(words), dtype=np.uint8)
    place, state = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    arc, target, output = lexicon["arc"], lexicon["target"], lexicon["output"]
    alive = np.arange(len(words))
    done = np.full(len(words), -1, dtype=np.int64)
    depth = 0
    while len(alive):
        ending = size[alive] == depth
        over = alive[ending]
        done[over] = np.where(lexicon["accepts"][state[over]], place[over], -1)
        alive = alive[~ending]
        if not len(arc):
            break
        key = state[alive] << 8 | text[first[alive] + depth]
        at = np.minimum(np.searchsorted(arc, key), len(arc) - 1)
        hit = arc[at] == key
        alive, at = alive[hit], at[hit]
        place[alive] += output[at]
        state[alive] = target[at]
        depth += 1
    return done
