"""A small causal self-attention model in numpy: one layer, one head, over classes of tokens.

Classes come in groups of MEMBERS; the output is a group and a member of it, each a softmax.
"""

from __future__ import annotations

import numpy as np

CONTEXT = 32  # tokens in a window
STRIDE = 16  # tokens by which windows move on; each window behind a text's first scores so many new tokens
WIDTH = 16
MEMBERS = 32
BLOCK = 64  # windows whose attention is held in a core's cache
Weights = dict[str, np.ndarray]


def initial(prior: np.ndarray, seed: int = 1) -> Weights:
    """Random weights; the output biases are the logs of the classes' shares, given for all classes."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    root, groups = WIDTH**-0.5, len(prior) // MEMBERS
    mass = np.exp(prior).reshape(groups, MEMBERS)
    share = mass / mass.sum(axis=1, keepdims=True)
    return {
        "embed": draw(len(prior), WIDTH, scale=0.5), "place": draw(CONTEXT, WIDTH, scale=0.1), **{k: draw(WIDTH, WIDTH, scale=root) for k in ("query", "key", "value", "mix")},
        "out": draw(WIDTH, groups, scale=0.1), "bias": np.log(mass.sum(axis=1)).astype(np.float32), "out2": draw(groups, WIDTH, MEMBERS, scale=0.1), "bias2": np.log(share).astype(np.float32),
    }


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def restore(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_ahead = np.triu(np.full((CONTEXT, CONTEXT), -1e9, np.float32), 1)


def _bounded(x: np.ndarray) -> np.ndarray:
    """Logits cut off at 60 either way, in place: far beyond any that training gives, and no sum of their exponentials is zero or
    infinite. What is masked is so afterwards, and has a weight of zero."""
    return np.clip(x, -60, 60, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[-1], x.dtype)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _inputs(w: Weights, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the classes at their places, and the products of weights by which they meet and what they carry: queries, keys
    and values are not made one by one, as only their products are used."""
    x = np.take(w["embed"], c, axis=0)
    x += w["place"][: c.shape[1]]
    return x, (w["query"] @ w["key"].T) * np.float32(WIDTH**-0.5), w["value"] @ w["mix"]


def _heads(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Output weights with their biases as a last row, for vectors with a last 1."""
    return np.vstack([w["out"], w["bias"]]), np.concatenate([w["out2"], w["bias2"][:, None]], axis=1)


def _turned(x: np.ndarray) -> np.ndarray:
    """Each window's vectors as columns, with a last row of 1: products by windows go faster with them so."""
    out = np.empty((len(x), WIDTH + 1, x.shape[1]), x.dtype)
    out[:, :WIDTH], out[:, WIDTH] = x.transpose(0, 2, 1), 1
    return out


def _small(h: np.ndarray, head: np.ndarray, heads: np.ndarray) -> bool:
    """Whether no logit of these vectors can be beyond the bound, by the lengths of vectors and weights."""
    most = np.sqrt(np.einsum("ij,ij->i", h, h).max(initial=0))
    top = lambda w: (np.sqrt((w[..., :WIDTH, :] ** 2).sum(axis=-2)) * most + np.abs(w[..., WIDTH, :])).max()
    return bool(max(top(head), top(heads)) < 60)


def _with_one(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty((len(h), WIDTH + 1), h.dtype)
    out[:, :WIDTH], out[:, WIDTH] = np.take(h, order, axis=0), 1
    return out


def log_probs(w: Weights, c: np.ndarray, y: np.ndarray, first: int) -> np.ndarray:
    """Natural log probabilities (n, T - first) of the target classes y (n, T - first), given windows of classes c (n, T):
    the first places serve as context only."""
    n, size = c.shape
    x, meet, carry = _inputs(w, c)
    late = np.ascontiguousarray(x[:, first:])
    u, o = (_flat(late) @ meet).reshape(late.shape), np.empty_like(late)
    for s in range(0, n, BLOCK):
        b = slice(s, s + BLOCK)
        a = _bounded(u[b] @ _turned(x[b])[:, :WIDTH])
        a += _ahead[first:size, :size]
        np.exp(a, out=a)
        np.matmul(a, x[b], out=o[b])
        o[b] /= _sums(a)[..., None]
    h = _flat(late)
    h += _flat(o) @ carry
    order, cuts, group, member = _by_group(y, len(w["bias"]))
    (head, heads), rows = _heads(w), _with_one(h, order)
    more, small = np.empty(len(rows), h.dtype), _small(h, head, heads)
    for s in range(0, len(rows), BLOCK * CONTEXT):
        b = slice(s, s + BLOCK * CONTEXT)
        more[b] = _softmax_log(rows[b] @ head, group[b], small)
    for g, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if s < e:
            more[s:e] += _softmax_log(rows[s:e] @ heads[g], member[s:e], small)
    out = np.empty_like(more)
    out[order] = more
    return out.reshape(n, size - first)


def _by_group(y: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in the order of the groups of their classes, the groups' bounds, groups and members in that order)."""
    y = y.ravel().astype(np.int16)
    order = np.argsort(y // MEMBERS, kind="stable")
    y = y[order]
    group = y // MEMBERS
    return order, np.searchsorted(group, np.arange(groups + 1)), group, y - group * MEMBERS


def _softmax_log(logits: np.ndarray, target: np.ndarray, small: bool) -> np.ndarray:
    """Log of the softmax of the logits at the targets; the logits, `small` if within the bound, are overwritten."""
    if not small:
        _bounded(logits)
    chosen = logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + target]
    np.exp(logits, out=logits)
    return chosen - np.log(_sums(logits))


def _error(logits: np.ndarray, target: np.ndarray, weight: np.ndarray, small: bool, want: bool) -> float:
    """The loss at the targets by the softmax of the logits, `small` if within the bound, which its gradient by them overwrites;
    zero if it is not wanted."""
    np.exp(logits if small else _bounded(logits), out=logits)
    total = _sums(logits)
    flat, at = logits.ravel(), np.arange(0, logits.size, logits.shape[1]) + target
    loss = -float(np.log(flat[at] / total + 1e-30) @ weight) if want else 0.0
    logits *= (weight / total)[:, None]
    flat[at] -= weight
    return loss


def gradient(w: Weights, c: np.ndarray, y: np.ndarray, use: np.ndarray, want: bool = True) -> tuple[float, Weights]:
    """Mean loss over the used places, if it is wanted, and its gradient."""
    x, meet, carry = _inputs(w, c)
    u, size, o, xt = np.empty_like(x), c.shape[1], np.empty_like(x), np.empty((len(c), WIDTH + 1, c.shape[1]), x.dtype)
    blocks = [slice(s, s + BLOCK) for s in range(0, len(c), BLOCK)]
    weights, sums, h = [], np.empty(c.shape, x.dtype), np.empty_like(x)  # weights before they are divided by their sums: vectors are instead
    for b in blocks:
        np.matmul(_flat(x[b]), meet, out=_flat(u[b]))
        xt[b] = _turned(x[b])
        a = _bounded(u[b] @ xt[b, :WIDTH])
        a += _ahead[:size, :size]
        np.exp(a, out=a)
        weights.append(a)
        np.matmul(a, x[b], out=o[b])
        sums[b] = _sums(a)
        o[b] /= sums[b, :, None]
        np.matmul(_flat(o[b]), carry, out=_flat(h[b]))
        h[b] += x[b]
    h = _flat(h)

    order, cuts, group, member = _by_group(y, len(w["bias"]))
    (head, heads), rows = _heads(w), _with_one(h, order)
    weight = (use.ravel() / max(1, int(use.sum()))).astype(h.dtype)[order]
    loss, ghead, gheads, d, small = 0.0, np.zeros_like(head), np.zeros_like(heads), np.empty_like(h), _small(h, head, heads)
    for s in range(0, len(rows), BLOCK * CONTEXT):
        e = min(s + BLOCK * CONTEXT, len(rows))
        p = rows[s:e] @ head
        loss += _error(p, group[s:e], weight[s:e], small, want)
        ghead += rows[s:e].T @ p
        np.matmul(p, w["out"].T, out=d[s:e])
    for g, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if s < e:
            p = rows[s:e] @ heads[g]
            loss += _error(p, member[s:e], weight[s:e], small, want)
            np.matmul(rows[s:e].T, p, out=gheads[g])
            d[s:e] += p @ w["out2"][g].T
    grad = {"out": ghead[:WIDTH], "bias": ghead[WIDTH], "out2": gheads[:, :WIDTH], "bias2": gheads[:, WIDTH]}
    dh = np.empty_like(d)
    dh[order] = d

    dx, dh = np.empty_like(x), dh.reshape(x.shape)
    dmeet, dcarry = np.zeros_like(meet), np.zeros_like(carry)
    for b, a in zip(blocks, weights, strict=True):
        both = np.empty((*dh[b].shape[:2], WIDTH + 1), x.dtype)  # with what is subtracted, by the row of 1
        do = both[..., :WIDTH]
        np.divide((_flat(dh[b]) @ carry.T).reshape(do.shape), sums[b, :, None], out=do)
        np.negative(np.einsum("ntd,ntd->nt", o[b], do), out=both[..., WIDTH])
        ds = both @ xt[b]
        ds *= a
        t = ds @ x[b]
        np.matmul(a.transpose(0, 2, 1), do, out=dx[b])
        dx[b] += ds.transpose(0, 2, 1) @ u[b]
        dx[b] += (_flat(t) @ meet.T).reshape(t.shape)
        dx[b] += dh[b]
        dmeet += _flat(x[b]).T @ _flat(t)
        dcarry += _flat(o[b]).T @ _flat(dh[b])
    dmeet *= np.float32(WIDTH**-0.5)
    dx = _flat(dx)
    grad |= {"query": dmeet @ w["key"], "key": dmeet.T @ w["query"], "value": dcarry @ w["mix"].T, "mix": w["value"].T @ dcarry}
    grad["place"] = np.zeros_like(w["place"])
    grad["place"][:size] = dx.reshape(x.shape).sum(axis=0)
    c = c.ravel().astype(np.int16)
    times = np.bincount(c, minlength=len(w["embed"]))
    some = np.flatnonzero(times)
    grad["embed"] = np.zeros_like(w["embed"])
    grad["embed"][some] = np.add.reduceat(np.take(dx, np.argsort(c, kind="stable"), axis=0), (np.cumsum(times) - times)[some])
    return loss, grad


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, grad: Weights) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.w[k] -= (self.rate / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
