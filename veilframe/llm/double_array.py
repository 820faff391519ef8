"""A trie of sorted sequences packed into two arrays.

State t is a child of state s by code c if BASE[s] + c = t and CHECK[t] = s. State 0 is the root.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bases tried at a time and in all for a node of several children before it goes behind all others.
AT_A_TIME, TRIES = 8, 64


@dataclass(frozen=True)
class DoubleArray:
    base: np.ndarray
    check: np.ndarray

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children by `codes`; -1 where there is none."""
        to = self.base[states] + codes
        inside = to < len(self.check)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states) & (to > 0), to, -1)

    def levels(self, codes: np.ndarray, ends: np.ndarray):
        """Walks all sequences at once: per depth, the sequences that reach it and their states there.

        Sequence i is codes[ends[i - 1] : ends[i]].
        """
        starts = np.r_[0, ends[:-1]]
        sizes, states = ends - starts, np.zeros(len(ends), np.int64)
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            here = np.flatnonzero(sizes >= depth)
            states[here] = self.step(states[here], codes[starts[here] + depth - 1])
            yield here, states[here]


def pack(codes: np.ndarray, ends: np.ndarray) -> DoubleArray:
    """The double array of sequences over codes 1, 2, ..., sorted so that equal beginnings stand together."""
    parents, labels, nodes = _edges(codes, ends)
    order = np.lexsort((labels, parents))
    parents, labels, children = parents[order], labels[order], order + 1  # edge e leads to node e + 1
    owners, first, counts = np.unique(parents, return_index=True, return_counts=True)
    alphabet = int(codes.max(initial=0)) + 1
    span = 2 * nodes  # bases to choose from: half of the places stay free, so few tries fail
    size = alphabet + span + AT_A_TIME
    base, check, state = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(nodes, np.int64)
    check[0], next_base, stride = 0, 0, max(1, int(span * 0.618))  # bases far apart keep the places evenly filled
    placed, owner = [], []
    many = np.flatnonzero(counts > 1)
    for k in many[np.argsort(-counts[many], kind="stable")].tolist():
        own, at = labels[first[k] : first[k] + counts[k]], -1
        for _ in range(TRIES // AT_A_TIME):
            tried = next_base + np.arange(AT_A_TIME)
            good = np.flatnonzero((check[tried[:, None] + own] == -1).all(axis=1))
            next_base = (next_base + stride) % span
            if len(good):
                at = int(tried[good[0]])
                break
        if at < 0:
            at = len(check) - int(own[0])
            more = int(own[-1] - own[0]) + 1
            base, check = np.r_[base, np.zeros(more, np.int64)], np.r_[check, np.full(more, -1, np.int64)]
        to = at + own
        check[to] = owners[k]  # nodes for now, states below
        placed.append((int(owners[k]), at))
        state[children[first[k] : first[k] + counts[k]]] = to
        owner.append(to)
    # A lone child fits into any free place that its code reaches.
    lone = np.flatnonzero(counts == 1)
    room = np.flatnonzero(check == -1)
    room = room[room >= alphabet]
    if len(room) < len(lone):
        more = len(lone) - len(room)
        room = np.r_[room, len(check) + np.arange(more)]
        base, check = np.r_[base, np.zeros(more, np.int64)], np.r_[check, np.full(more, -1, np.int64)]
    room = room[: len(lone)]
    check[room], state[children[first[lone]]] = owners[lone], room
    used = np.r_[np.concatenate(owner) if owner else np.zeros(0, np.int64), room].astype(np.int64)
    check[used] = state[check[used]]
    base[state[owners[lone]]] = room - labels[first[lone]]
    for node, at in placed:
        base[state[node]] = at
    end = int(used.max(initial=0)) + 1
    return DoubleArray(base[:end], check[:end])


def _edges(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Parent node and code of the edges to nodes 1, 2, ..., level by level, and the number of nodes."""
    starts = np.r_[0, ends[:-1]]
    sizes, node = ends - starts, np.zeros(len(ends), np.int64)
    alike = np.r_[False, np.ones(max(0, len(ends) - 1), bool)]  # with the sequence before, so far
    parents, labels, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    for depth in range(1, int(sizes.max(initial=0)) + 1):
        here = np.flatnonzero(sizes >= depth)
        label = codes[starts[here] + depth - 1]
        same = np.zeros(len(here), bool)
        same[1:] = (here[1:] == here[:-1] + 1) & alike[here[1:]] & (label[1:] == label[:-1])
        new = np.flatnonzero(~same)
        parents.append(node[here[new]])
        labels.append(label[new])
        node[here] = nodes + np.cumsum(~same) - 1
        nodes += len(new)
        alike[:] = False
        alike[here] = same
    return np.concatenate(parents), np.concatenate(labels), nodes
