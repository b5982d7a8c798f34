"""A gated recurrent language model in numpy.

One gated recurrent layer reads word inputs; the output is a softmax over word
classes and, for classes of explicit words, a softmax over the members.  Training
is truncated backpropagation through time with Adam; scoring carries the state
over all windows of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 24
EMBED = 16
#: Steps of a training window and streams trained side by side.
STEPS = 16
STREAMS = 256
#: Documents read side by side when scoring, rows scored at once, and of these the
#: rows whose class scores fit a core's cache.
LANES = 512
ROWS = 8192
CACHED = 512
RATE = 0.015
CLIP = 1.0
NEVER = np.float32(-1e9)
#: Parameters that are updated at once, so that their moments stay in a core's cache.
UPDATED = 8192
#: Powers of two take half the time of powers of e; scores are turned into their logs by scaled weights.
LOG2E = np.float32(1 / np.log(2))


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: inputs, classes, explicit classes and their members."""

    inputs: int
    classes: int
    explicit: int
    members: int


@dataclass
class Tokens:
    """Documents one after the other: input, class, member (-1: none), unseen share.

    ``first`` marks the first token of each document; ``unseen`` is the share of
    the last class (unseen words) in a token's target.  ``weight`` is 0 for tokens
    that only fill up a window.
    """

    inputs: np.ndarray
    classes: np.ndarray
    members: np.ndarray
    unseen: np.ndarray
    first: np.ndarray
    weight: np.ndarray | None = None

    def part(self, start: int, end: int) -> Tokens:
        return Tokens(*(x[start:end] for x in (self.inputs, self.classes, self.members, self.unseen, self.first)))


Params = dict[str, np.ndarray]


def fresh(shape: Shape, class_bias: np.ndarray, member_bias: np.ndarray) -> Params:
    """Parameters that predict the given log frequencies, whatever the context."""
    r = np.random.default_rng(3)
    draw = lambda *size: (r.standard_normal(size) / np.sqrt(size[-2])).astype(np.float32)
    bias = np.zeros(3 * HIDDEN, np.float32)
    bias[:HIDDEN] = 1.0
    return {
        "embed": draw(shape.inputs, EMBED) * np.float32(np.sqrt(shape.inputs) * 0.3),
        "read": draw(EMBED, 3 * HIDDEN),
        "keep": draw(HIDDEN, 3 * HIDDEN),
        "bias": bias,
        "out": np.zeros((HIDDEN, shape.classes), np.float32),
        "out_bias": class_bias.astype(np.float32),
        "member": np.zeros((shape.explicit, HIDDEN, shape.members), np.float32),
        "member_bias": member_bias.astype(np.float32),
    }


def laid(p: Params) -> tuple[np.ndarray, Params]:
    """A copy of the parameters in one array, and its parts by name."""
    values, parts, at = flat(p), {}, 0
    for k in sorted(p):
        parts[k] = values[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    return values, parts


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def bounded(weights: np.ndarray) -> bool:
    """Whether no score of a state (whose parts are -1 to 1) is large; the last row of weights is the bias."""
    return bool((np.abs(weights[:-1]).sum(0) + weights[-1]).max(initial=0) < 60)


def ordered(values: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers from 0; those of 16 bits are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values, kind="stable")


def exponentials(rows: np.ndarray, small: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two to the power of scores, which are used up, and the sums of its rows.

    Scores are moved down by their row's greatest only where one is large; none
    is if they are known to be ``small``.
    """
    if not small and rows.max(initial=0) > 60:
        rows -= rows.max(1, keepdims=True)
    np.exp2(rows, out=rows)
    return rows, rows @ np.ones(rows.shape[1], rows.dtype)


def log_softmax(rows: np.ndarray) -> np.ndarray:
    rows = rows - rows.max(1, keepdims=True)
    return rows - np.log(np.exp(rows).sum(1, keepdims=True))


def halved(weights: np.ndarray) -> np.ndarray:
    """A copy whose last axis has the gates' part halved, as ``advance`` takes it."""
    out = weights.copy()
    out[..., : 2 * HIDDEN] *= out.dtype.type(0.5)
    return out


def advance(keep: np.ndarray, read: np.ndarray, h: np.ndarray, gates: np.ndarray, cand: np.ndarray, hidden: np.ndarray | None, half: bool = False) -> np.ndarray:
    """The next states, a column each; ``read``: projected inputs, ``keep``: transposed.

    The three arguments after ``h`` receive what the backward pass needs.  With ``half``
    the gates' part of both weights is halved already.
    """
    kept = keep @ h
    np.add(read[: 2 * HIDDEN], kept[: 2 * HIDDEN], out=gates)
    if not half:
        gates *= gates.dtype.type(0.5)
    np.tanh(gates, out=gates)
    gates *= gates.dtype.type(0.5)
    gates += gates.dtype.type(0.5)
    if hidden is not None:
        hidden[:] = kept[2 * HIDDEN :]
    np.multiply(kept[2 * HIDDEN :], gates[HIDDEN:], out=cand)
    cand += read[2 * HIDDEN :]
    np.tanh(cand, out=cand)
    after = h - cand
    after *= gates[:HIDDEN]
    after += cand
    return after


def step(p: Params, read: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next states, a row each, with what the backward pass needs; ``read``: projected inputs."""
    kind = np.result_type(read, h, p["keep"])
    parts = [np.empty((size, len(h)), kind) for size in (2 * HIDDEN, HIDDEN, HIDDEN)]
    after = advance(p["keep"].T, read.T, h.T, *parts)
    return after.T, parts[0][:HIDDEN].T, parts[0][HIDDEN:].T, parts[1].T, parts[2].T


def by_class(classes: np.ndarray, members: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each explicit class with the rows whose token is in it."""
    rows = np.flatnonzero(members >= 0)
    rows = rows[ordered(classes[rows])]
    if not len(rows):
        return []
    cut = np.flatnonzero(np.diff(classes[rows])) + 1
    return [(int(classes[x[0]]), x) for x in np.split(rows, cut)]


def gradients(p: Params, window: Tokens, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """Mean gradients over a window of (steps, streams) tokens, the last state, the loss.

    The state ``h`` comes from the window before and gets no gradient: truncated
    backpropagation through time.
    """
    steps, streams = window.inputs.shape
    used = window.inputs.ravel()
    # States and gates are columns, so that each gate's are side by side in memory.
    table = p["embed"] @ p["read"]
    table += p["bias"]
    table[:, : 2 * HIDDEN] *= table.dtype.type(0.5)
    read = np.ascontiguousarray(table.take(used, 0).reshape(steps, streams, -1).transpose(0, 2, 1))
    opens = window.first.any(1)
    before, cand, hidden = (np.empty((steps, HIDDEN, streams), table.dtype) for _ in range(3))
    gates = np.empty((steps, 2 * HIDDEN, streams), table.dtype)
    keep, h = np.ascontiguousarray(halved(p["keep"]).T), h.T
    for t in range(steps):
        if opens[t]:
            h = np.where(window.first[t], table.dtype.type(0), h)
        before[t] = h
        h = advance(keep, read[t], h, gates[t], cand[t], hidden[t], True)
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    n = len(used)
    # A last column of ones brings the bias; errors are left unscaled, their rows' scales go to the narrow side.
    wide = np.ones((n, HIDDEN + 1), table.dtype)
    wide[:, :-1].reshape(steps, streams, HIDDEN)[:] = before.transpose(0, 2, 1)
    weight = np.ones(n, np.float32) if window.weight is None else window.weight.ravel()
    total = max(float(weight.sum()), 1.0)
    at = np.arange(n)
    classes, members, unseen = window.classes.ravel(), window.members.ravel(), window.unseen.ravel()
    weight = weight / np.float32(total)
    out = np.concatenate([p["out"], p["out_bias"][None]])
    small, across, g_out, loss = bounded(out), np.ascontiguousarray(p["out"].T), 0, 0.0
    out *= out.dtype.type(LOG2E)
    cells = at[:CACHED] * out.shape[1]
    back = np.empty((n, HIDDEN), table.dtype)
    for low in range(0, n, CACHED):
        part = slice(low, low + CACHED)
        mine, own, given, rest = wide[part], classes[part], weight[part], unseen[part]
        error, sums = exponentials(mine @ out, small)
        cell, line = cells[: len(mine)] + own, error.ravel()
        hit = line.take(cell)
        loss -= float(np.log(hit / sums + 1e-20) @ given)
        line[cell] = hit - (1 - rest) * sums
        error[:, -1] -= rest * sums
        scale = given / sums
        g_out = g_out + np.multiply(mine.T, scale, order="C") @ error
        np.multiply(error @ across, scale[:, None], out=back[part])
    g = {"out": g_out[:-1], "out_bias": g_out[-1]}
    member = np.concatenate([p["member"], p["member_bias"][:, None]], 1)
    member *= member.dtype.type(LOG2E)
    g_member = np.zeros_like(member)
    tame = (np.abs(p["member"]).sum(1) + p["member_bias"]).max(1, initial=0) < 60
    if explicit := by_class(classes, members):
        rows = np.concatenate([own for _, own in explicit])
        taken, chosen = wide.take(rows, 0), members[rows]
        cells = at * member.shape[2]
        extra = np.empty((len(rows), HIDDEN), table.dtype)
        thin = np.ascontiguousarray(p["member"].transpose(0, 2, 1))
        high = 0
        for c, own in explicit:
            low, high = high, high + len(own)
            mine = taken[low:high]
            e, sums = exponentials(mine @ member[c], tame[c])
            e.ravel()[cells[: high - low] + chosen[low:high]] -= sums
            scale = (np.float32(1 / total) / sums)[:, None]
            np.matmul((mine * scale).T, e, out=g_member[c])
            np.multiply(e @ thin[c], scale, out=extra[low:high])
        back[rows] += extra
    g["member"], g["member_bias"] = g_member[:, :-1], g_member[:, -1]
    back = np.ascontiguousarray(back.reshape(steps, streams, HIDDEN).transpose(0, 2, 1))
    # Errors of the candidate, both gates and, what the kept state brought to it, the candidate again.
    parts = np.empty((steps, 4 * HIDDEN, streams), table.dtype)
    slope = z * (1 - z)
    slope *= before - cand
    to_cand, to_r = (1 - z) * (1 - cand * cand), hidden * r * (1 - r)
    dh = np.zeros_like(back[0])
    for t in reversed(range(steps)):
        now = parts[t]
        dn = np.multiply(dh, to_cand[t], out=now[:HIDDEN])
        np.multiply(dh, slope[t], out=now[HIDDEN : 2 * HIDDEN])
        np.multiply(dn, to_r[t], out=now[2 * HIDDEN : 3 * HIDDEN])
        np.multiply(dn, r[t], out=now[3 * HIDDEN :])
        dh *= z[t]
        dh += p["keep"] @ now[HIDDEN:]
        dh += back[t]
        if opens[t]:
            dh[:, window.first[t]] = 0
    g["keep"] = np.matmul(before, parts[:, HIDDEN:].transpose(0, 2, 1)).sum(0)
    into = parts[:, : 3 * HIDDEN]
    shown = p["embed"].take(used, 0).reshape(steps, streams, -1)
    g["read"] = np.roll(np.matmul(into, shown).sum(0), -HIDDEN, 0).T
    g["bias"] = np.roll(into.sum((0, 2)), -HIDDEN)
    order = ordered(used)
    first = np.flatnonzero(np.append(True, np.diff(used[order]) != 0))
    spread = np.matmul(into.transpose(0, 2, 1), np.roll(p["read"], HIDDEN, 1).T).reshape(n, -1)
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][used[order[first]]] = np.add.reduceat(spread.take(order, 0), first)
    return g, h.T, loss


class Trainer:
    """Adam over windows of streams; documents are joined and dealt to the streams."""

    def __init__(self, p: Params) -> None:
        # Parameters and gradients lie one after the other; those by name are parts of them.
        self.values, self.p = laid(p)
        self.given, self.g = laid(p)
        self.mean, self.square = np.zeros_like(self.values), np.zeros_like(self.values)
        self.updates = 0
        self.loss = 0.0

    def learn(self, tokens: Tokens) -> int:
        """One pass over joined documents; returns the number of tokens read.

        The last stream is filled up with tokens that weigh nothing.
        """
        n = len(tokens.inputs)
        streams = max(1, min(STREAMS, n // STEPS))
        length = -(-n // streams)
        full = (tokens.inputs, tokens.classes, tokens.members, tokens.unseen, tokens.first, np.ones(n, np.float32))
        fill = (0, 0, -1, 0, True, 0)
        dealt = [np.concatenate([x, np.full(length * streams - n, f, x.dtype)]).reshape(streams, length).T for x, f in zip(full, fill, strict=True)]
        h = np.zeros((streams, HIDDEN), np.float32)
        for t in range(0, length, STEPS):
            g, h, self.loss = gradients(self.p, Tokens(*(x[t : t + STEPS] for x in dealt)), h)
            self._update(g)
        return n

    def _update(self, g: Params) -> None:
        self.updates += 1
        for k, v in g.items():
            self.g[k][...] = v
        norm = np.sqrt(float(self.given @ self.given))
        scale = np.float32(min(1.0, CLIP / (norm + 1e-12)))
        rate = np.float32(RATE * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates))
        for low in range(0, len(self.values), UPDATED):
            v, m, s, values = (x[low : low + UPDATED] for x in (self.given, self.mean, self.square, self.values))
            v *= scale
            m *= np.float32(0.9)
            s *= np.float32(0.999)
            m += np.float32(0.1) * v
            v *= v
            v *= np.float32(0.001)
            s += v
            np.sqrt(s, out=v)
            v += np.float32(1e-8)
            np.divide(m, v, out=v)
            v *= rate
            values -= v


def lanes(lengths: np.ndarray, count: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; longest lane first."""
    import heapq

    heap = [(0, k) for k in range(min(count, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), k))
    return sorted(out, key=lambda ds: -sum(int(lengths[d]) for d in ds))


def log_probabilities(p: Params, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs of each token's probability and of an unseen word's there.

    The state begins at zero in each document and is carried to its end.  A token
    of a class without members gets its class's probability.
    """
    n = len(tokens.inputs)
    own, unseen = np.empty(n), np.empty(n)
    starts = np.flatnonzero(tokens.first)
    lengths = np.diff(np.append(starts, n))
    dealt = lanes(lengths, LANES)
    order = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for lane in dealt for d in lane]) if n else np.empty(0, int)
    sizes = np.array([sum(int(lengths[d]) for d in lane) for lane in dealt], int)
    # Tokens by step, in each the lanes that still have one, the longest first.
    turn = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = order[np.argsort(turn, kind="stable")]
    ends = np.cumsum(np.bincount(turn)).tolist()
    inputs, first = tokens.inputs[order], tokens.first[order]
    opens = np.logical_or.reduceat(first, [0, *ends[:-1]]).tolist() if n else []
    table = halved(p["embed"] @ p["read"] + p["bias"])
    keep = np.ascontiguousarray(halved(p["keep"]).T)
    last = p["out"].shape[1] - 1
    out = np.concatenate([p["out"], (p["out_bias"] - p["out_bias"].max())[None]])
    member = np.concatenate([p["member"], (p["member_bias"] - p["member_bias"].max(1, keepdims=True))[:, None]], 1)
    small, small_members = bounded(out), [bounded(m) for m in member]
    across, member = np.ascontiguousarray(out.T) * LOG2E, member * LOG2E
    ones = np.ones(len(across), np.float32)
    states = np.ones((HIDDEN + 1, ROWS + len(dealt)), np.float32)
    place = np.arange(states.shape[1])
    h = np.zeros((HIDDEN, len(dealt)), np.float32)

    def flush(start: int, end: int) -> None:
        rows, at = np.ascontiguousarray(states[:, : end - start].T), order[start:end]
        classes, members = tokens.classes[at], tokens.members[at]
        found, other, total = (np.empty(len(rows), np.float32) for _ in range(3))
        for low in range(0, len(rows), CACHED):
            part = slice(low, low + CACHED)
            # Classes by states: columns are side by side already.
            scores = across @ states[:, low : min(low + CACHED, end - start)]
            if not small:
                scores -= scores.max(0)
            found[part], other[part] = scores[classes[part], place[: scores.shape[1]]], scores[last]
            total[part] = ones @ np.exp2(scores, out=scores)
        logs = np.log(total.astype(np.float64))
        own[at], unseen[at] = found / LOG2E - logs, other / LOG2E - logs
        if explicit := by_class(classes, members):
            mine = np.concatenate([x for _, x in explicit])
            taken, chosen, high = rows.take(mine, 0), members[mine], 0
            for c, x in explicit:
                low, high = high, high + len(x)
                scores = taken[low:high] @ member[c]
                if not small_members[c]:
                    scores -= scores.max(1, keepdims=True)
                found[low:high] = scores[place[: len(x)], chosen[low:high]]
                total[low:high] = exponentials(scores, True)[1]
            own[at[mine]] += found[:high] / LOG2E - np.log(total[:high].astype(np.float64))

    gates = cand = np.empty((0, 0), np.float32)
    flushed = start = 0
    for end, opened in zip(ends, opens, strict=True):
        h = h[:, : end - start]
        if opened:
            h = np.where(first[start:end], np.float32(0), h)
        states[:HIDDEN, start - flushed : end - flushed] = h
        live = end - start
        if gates.shape[1] != live:
            gates, cand = (np.empty((size, live), np.float32) for size in (2 * HIDDEN, HIDDEN))
        h = advance(keep, np.ascontiguousarray(table.take(inputs[start:end], 0).T), h, gates, cand, None, True)
        start = end
        if start - flushed >= ROWS:
            flush(flushed, start)
            flushed = start
    if start > flushed:
        flush(flushed, start)
    return own, unseen
