"""A robust-pruned directed graph over the vectors of one shard: built and searched for many rows at once.

All functions work on whole batches of queries: a beam search holds one beam per
row of its matrices, expands the nearest nodes of all beams together and leaves
finished rows out.  Nothing here knows of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from kinweave.session import ship_functions

ship_functions(__name__)

#: Edges of a node, nodes of a beam while building, and how much farther a detour may be before an edge goes (squared).
DEGREE, BUILD_BEAM, RELAXED = 40, 64, 1.2 ** 2
#: Nodes expanded at once per beam, and rows searched together.
AT_ONCE, ROWS = 4, 512
#: Nodes far from each other where searches begin, and the random nodes they are chosen from.
SEEDS, SEED_POOL = 64, 2048
NONE = -1


@dataclass
class Graph:
    """Points (n, d), their neighbours (n, DEGREE) padded with NONE, and the nodes where searches begin.

    Many entries lie apart, since the edges of a large dense group hardly leave it.
    """

    points: np.ndarray
    edges: np.ndarray
    entries: np.ndarray


def distances(points: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distance of each row vector to its one target."""
    gap = points[targets] - rows
    return np.einsum("ij,ij->i", gap, gap)


def beam_search(graph: Graph, queries: np.ndarray, beam: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances), both (queries, beam), nearest first; NONE and infinity where fewer were reached.

    A shard of no more nodes than the beam holds is in the beam from the start.
    """
    n = len(graph.points)
    out_ids = np.full((len(queries), beam), NONE, np.int32)
    out_far = np.full((len(queries), beam), np.inf, np.float32)
    for first in range(0, len(queries), ROWS):
        q = queries[first: first + ROWS]
        live = np.arange(len(q))
        seen = np.zeros((len(q), n), np.int16)
        ids = np.full((len(q), beam), NONE, np.int32)
        far = np.full((len(q), beam), np.inf, np.float32)
        begin = np.arange(n) if n <= beam else graph.entries[:beam]
        ids[:, : len(begin)] = begin
        for k, node in enumerate(begin):
            far[:, k] = distances(graph.points, q, np.full(len(q), node))
        seen[:, begin] = -1
        opened = ids == NONE
        while len(live):
            rank = np.where(opened, np.inf, far)
            step = min(at_once, beam)
            pick = np.argpartition(rank, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(live), 1))
            usable = np.isfinite(np.take_along_axis(rank, pick, 1))
            more = usable.any(axis=1)
            if not more.all():
                done = live[~more]
                out_ids[first + done], out_far[first + done] = ids[~more], far[~more]
                live, ids, far, opened, pick, usable, q, seen = (x[more] for x in (live, ids, far, opened, pick, usable, q, seen))
                if not len(live):
                    break
            np.put_along_axis(opened, pick, True, 1)
            from_nodes = np.where(usable, np.take_along_axis(ids, pick, 1), 0)
            found = np.where(usable[:, :, None], graph.edges[from_nodes], NONE).reshape(len(live), -1)
            row, slot = np.nonzero(found != NONE)
            node = found[row, slot]
            fresh = seen[row, node] == 0
            row, slot, node = row[fresh], slot[fresh], node[fresh]
            seen[row, node] = slot + 1  # of equal nodes of a row the last slot stays
            last = seen[row, node] == slot + 1
            row, slot, node = row[last], slot[last], node[last]
            seen[row, node] = -1
            new_far = np.full(found.shape, np.inf, np.float32)
            new_far[row, slot] = distances(graph.points, q[row], node)
            all_far = np.concatenate([far, new_far], axis=1)
            all_ids = np.concatenate([ids, found], axis=1)
            all_opened = np.concatenate([opened, np.zeros(found.shape, bool)], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far, ids, opened = (np.take_along_axis(x, best, 1) for x in (all_far, all_ids, all_opened))
            opened |= ~np.isfinite(far)
    order = np.argsort(out_far, axis=1, kind="stable")
    out_ids, out_far = np.take_along_axis(out_ids, order, 1), np.take_along_axis(out_far, order, 1)
    out_ids[~np.isfinite(out_far)] = NONE
    return out_ids, out_far


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float = RELAXED) -> np.ndarray:
    """Up to `degree` of the candidates of each node, nearest first: one goes if a kept one is nearer to it by the relaxed factor.

    `candidates` is (nodes, any), padded with NONE; the node itself and repeats are left out.
    """
    out = np.full((len(nodes), degree), NONE, np.int32)
    for first in range(0, len(nodes), ROWS):
        node, cand = nodes[first: first + ROWS], candidates[first: first + ROWS]
        cand = np.sort(np.where(cand == node[:, None], NONE, cand), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = NONE
        gap = points[cand] - points[node][:, None, :]
        far = np.einsum("ijk,ijk->ij", gap, gap)
        far[cand == NONE] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        width = int(np.isfinite(far).sum(axis=1).max(initial=0))
        cand, far = cand[:, :width], far[:, :width]
        gap = points[cand] - points[node][:, None, :]  # seen from the node, so that dense groups keep their digits
        between = far[:, :, None] + far[:, None, :] - 2 * (gap @ gap.transpose(0, 2, 1))
        alive = np.isfinite(far)
        rows = np.arange(len(node))
        between = np.where(np.isfinite(between), between, np.inf)
        for k in range(degree):
            if not alive.any():
                break
            pick = alive.argmax(axis=1)
            has = alive[rows, pick]
            out[first + rows[has], k] = cand[rows[has], pick[has]]
            alive &= ~(relaxed * between[rows, pick] <= far) | ~has[:, None]
            alive[rows, pick] = False
    return out


def _add_back(points: np.ndarray, edges: np.ndarray, nodes: np.ndarray, degree: int) -> None:
    """For every edge of `nodes` the one back; a node that gets too many is pruned again."""
    source = np.repeat(nodes, edges.shape[1])
    target = edges[nodes].ravel()
    source, target = source[target != NONE], target[target != NONE]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    while len(target):
        begins = np.flatnonzero(np.diff(target, prepend=-1))
        place = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
        now = place < degree  # the others of a node that many point to come in later rounds
        who = target[begins]
        more = np.full((len(who), degree), NONE, np.int32)
        more[np.searchsorted(who, target[now]), place[now]] = source[now]
        both = np.concatenate([edges[who], more], axis=1)
        room = np.sort(np.where(both == who[:, None], NONE, both), axis=1)
        room[:, 1:][room[:, 1:] == room[:, :-1]] = NONE
        full = (room != NONE).sum(axis=1) > degree
        edges[who[~full]] = -np.sort(-room[~full], axis=1)[:, :degree]
        edges[who[full]] = robust_prune(points, who[full], room[full], degree)
        source, target = source[~now], target[~now]


def _apart(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of `count` points: each one is the farthest from those before."""
    chosen = [0]
    far = distances(points, np.broadcast_to(points[0], points.shape), np.arange(len(points)))
    while len(chosen) < count:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, np.broadcast_to(points[chosen[-1]], points.shape), np.arange(len(points))))
        far[chosen] = -1
    return np.array(chosen)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 1) -> Graph:
    """The graph of all points, inserted in random order in batches that grow with the graph.

    The entries come first and are linked with each other.  A batch searches the
    graph of those before it; what the searches found is pruned to the node's
    edges, then edges back are added.
    """
    n = len(points)
    points = np.ascontiguousarray(points, np.float32)
    edges = np.full((n, degree), NONE, np.int32)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    first = order[_apart(points[order[:SEED_POOL]], min(SEEDS, n))] if n else order
    order = np.concatenate([first, order[~np.isin(order, first)]])
    graph = Graph(points, edges, first)
    edges[first] = robust_prune(points, first, np.tile(first, (len(first), 1)).astype(np.int32), degree)
    _add_back(points, edges, first, degree)
    at = len(first)
    while at < n:
        batch = order[at: at + max(SEEDS, at // 4)]
        found, _ = beam_search(graph, points[batch], beam)
        edges[batch] = robust_prune(points, batch, found, degree)
        _add_back(points, edges, batch, degree)
        at += len(batch)
    return graph
