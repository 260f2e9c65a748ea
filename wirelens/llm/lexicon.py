"""A minimal acyclic transducer from words to places in a list, in one memory-mapped file.

States are shared by all words with the same endings. Every arc carries the number of words that leave
its state by smaller bytes (or end there), so the outputs along a word's path add up to the word's rank
among all words; a word's ids are found by its rank. Look-ups follow one byte of many words at a time.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x4C455831


def _automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Arcs and final marks of the minimal automaton of sorted, distinct words, and the first state.

    Words come in order, so everything off the path of the latest word is complete and can be replaced
    by an equal state that is already there.
    """
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    opened: list[list] = [[{}, False]]
    last = b""

    def close(depth: int) -> None:
        while len(opened) > depth + 1:
            out, ends = opened.pop()
            mark = (ends, tuple(out.items()))
            state = known.get(mark)
            if state is None:
                state = known[mark] = len(arcs)
                arcs.append(out)
                final.append(ends)
            opened[-1][0][last[len(opened) - 1]] = state

    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        close(shared)
        opened.extend([{}, False] for _ in word[shared:])
        opened[-1][1] = True
        last = word
    close(0)
    arcs.append(opened[0][0])
    final.append(opened[0][1])
    return arcs, final, len(arcs) - 1


def compile_lexicon(entries: dict[str, list[int]]) -> np.ndarray:
    """The file's content as 32-bit numbers: arcs by (state, byte), their targets and outputs, ids."""
    words = sorted(w.encode() for w in entries)
    arcs, final, start = _automaton(words)
    below = np.zeros(len(arcs), np.int64)  # words accepted from a state on
    keys, targets, outputs = [], [], []
    for state, out in enumerate(arcs):  # targets come before the states that lead to them
        count = int(final[state])
        for byte in sorted(out):
            keys.append(state << 8 | byte)
            targets.append(out[byte])
            outputs.append(count)
            count += int(below[out[byte]])
        below[state] = count
    ids = [entries[w.decode()] for w in words]
    lengths = [len(i) for i in ids]
    parts = [
        np.array([MAGIC, start, len(arcs), len(keys), len(words), sum(lengths)]),
        np.array(final),
        np.array(keys),
        np.array(targets),
        np.array(outputs),
        np.concatenate([[0], np.cumsum(lengths)]),
        np.array([i for one in ids for i in one]),
    ]
    return np.concatenate([p.astype(np.uint32) for p in parts])


class Lexicon:
    """Look-ups in the memory-mapped file; its pages are shared by all workers of a machine."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint32, "r")
        if data[0] != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        _, self.start, states, arcs, words, ids = data[:6].tolist()
        cuts = np.cumsum([6, states, arcs, arcs, arcs, words + 1, ids])
        self.final, self.keys, self.targets, self.outputs, self.cuts, self.ids = (
            data[a:b] for a, b in zip(cuts, cuts[1:])
        )

    def ranks(self, words: list[str]) -> np.ndarray:
        """The rank of every word, -1 where it isn't in the lexicon."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(lengths) - lengths
        state = np.full(len(raw), self.start, np.int64)
        rank = np.zeros(len(raw), np.int64)
        alive = np.arange(len(raw))
        step = 0
        while len(alive):
            done = lengths[alive] == step
            ended = alive[done]
            rank[ended[self.final[state[ended]] == 0]] = -1
            alive = alive[~done]
            if not len(alive) or not len(self.keys):
                break
            key = (state[alive] << 8 | text[first[alive] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            rank[alive] += self.outputs[at]
            state[alive] = self.targets[at]
            step += 1
        rank[alive] = -1
        return rank

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.cuts[rank] : self.cuts[rank + 1]].tolist()
