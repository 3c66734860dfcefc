"""A small causal self-attention model in numpy: forward and backward passes, training, scoring."""

from __future__ import annotations

import copy
import itertools

import numpy as np

#: Tokens that a window scores, and as many before them that it only looks at.
STRIDE = 16
WINDOW = 2 * STRIDE
#: Members of an output class; a token's probability is that of its class times that within the class.
CLASS = 32
#: Rows that training takes in a row.
RUN = 8


def keep_memory() -> None:
    """Lets the C library keep what arrays of up to 31 MB free for the next ones.

    Its limit for memory that is mapped, cleared and given back each time rises to the
    largest block that was freed; at first, steps spend a third of their time on this.
    """
    np.empty(31 << 20, dtype=np.uint8)


class Attention:
    """One layer with one head over token embeddings and a bias by distance, then a gated step and a two-level softmax.

    ``first`` marks the tokens that begin a word; they have classes of their own, so
    that the probability of a word's end is the sum over these classes.
    """

    def __init__(self, first: np.ndarray, often: np.ndarray, width: int = 16, keys: int = 8, hidden: int = 32, seed: int = 3):
        rng, n = np.random.default_rng(seed), len(first)
        order = np.lexsort((np.arange(n), -often, ~first))
        ahead = int(first.sum())
        place = np.arange(n)
        place[ahead:] += -ahead % CLASS  # the other tokens begin a new class
        self.class_of, self.member_of = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.class_of[order], self.member_of[order] = place // CLASS, place % CLASS
        self.first_classes, classes = -(-ahead // CLASS), int(place[-1]) // CLASS + 1
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        closed = np.full((classes, CLASS), -1e4)
        closed[self.class_of, self.member_of] = 0
        self.p = {
            "embed": rng.normal(0, 0.3, (n, width)), "q": draw(width, keys), "k": draw(width, keys), "v": draw(width, width), "o": draw(width, width),
            "near": np.linspace(1, -1, WINDOW), "w1": draw(width, hidden), "b1": np.zeros(hidden), "w2": draw(hidden, width) * 0.5,
            "class": draw(width, classes) * 0.1, "cb": np.zeros(classes), "member": rng.normal(0, 0.1, (classes, width, CLASS)), "mb": closed,
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tame = False
        distance = np.arange(STRIDE)[:, None] + STRIDE - np.arange(WINDOW)
        self.past, self.distance = distance >= 0, np.maximum(distance, 0)

    def attend(self, ids: np.ndarray, alone: np.ndarray) -> tuple:
        """Hidden states of the last ``STRIDE`` places of windows; ``alone`` windows have nothing before these."""
        p = self.p
        x = p["embed"][ids]
        q, k, v = x[:, STRIDE:] @ p["q"], x @ p["k"], x @ p["v"]
        s = q @ k.transpose(0, 2, 1) * np.float32(q.shape[2] ** -0.5)
        s += np.where(self.past, p["near"][self.distance], np.float32(-1e4))
        s[alone, :, :STRIDE] = -1e4
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        mixed = s @ v
        h = x[:, STRIDE:] + mixed @ p["o"]
        inner = np.maximum(h @ p["w1"] + p["b1"], 0)
        return x, q, k, v, s, mixed, h, inner, h + inner @ p["w2"]

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of their members, each with its bias as a last row: hidden states get a one for it."""
        p = self.p
        return np.concatenate([p["class"], p["cb"][None]]), np.concatenate([p["member"], p["mb"][:, None]], axis=1)

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each target, and of any token that begins a word, from hidden states (n, width)."""
        return self.looked_up(np.concatenate([h, np.ones((len(h), 1), dtype=h.dtype)], axis=1), target, *self.outputs())

    def looked_up(self, h: np.ndarray, target: np.ndarray, of_class: np.ndarray, of_member: np.ndarray, slab: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """``log_probabilities`` from hidden states with a one behind, and ``outputs``; a slab's logits stay in the processor's cache."""
        c = self.class_of[target]
        out, starts, total = (np.empty(len(c), dtype=np.float32) for _ in range(3))
        ahead = np.zeros((of_class.shape[1], 2), dtype=np.float32)
        ahead[:, 0], ahead[: self.first_classes, 1] = 1, 1
        logits = np.empty((min(slab, len(c)), of_class.shape[1]), dtype=np.float32)
        place = np.arange(slab)
        for a in range(0, len(c), slab):
            own = c[a : a + slab]
            at = slice(a, a + len(own))
            e = np.matmul(h[at], of_class, out=logits[: len(own)])
            if not self.tame:
                np.minimum(e, 80, out=e)
            out[at] = e[place[: len(own)], own]
            np.exp(e, out=e)
            both = e @ ahead
            total[at], starts[at] = both[:, 0], both[:, 1]
        starts /= total
        np.log(starts, out=starts)
        out -= np.log(total)
        order = np.argsort(c.astype(np.int16), kind="stable")
        count = np.bincount(c, minlength=of_class.shape[1])
        edge = np.r_[0, np.cumsum(count)]
        sorted_h, member = h.take(order, axis=0), self.member_of[target].take(order)
        inner, ones = np.empty(len(c), dtype=np.float32), np.ones(CLASS, dtype=np.float32)
        logits = np.empty((slab, CLASS), dtype=np.float32)
        for k in np.flatnonzero(count).tolist():
            for a in range(edge[k], edge[k + 1], slab):
                at = slice(a, min(a + slab, edge[k + 1]))
                m = member[at]
                e = np.matmul(sorted_h[at], of_member[k], out=logits[: len(m)])
                if not self.tame:
                    np.minimum(e, 80, out=e)
                inner[at] = e[place[: len(m)], m]
                np.exp(e, out=e)
                np.matmul(e, ones, out=total[at])
        inner -= np.log(total)
        out[order] += inner
        return out, starts

    def score(self, ids: np.ndarray, alone: np.ndarray, slab: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """For a stream cut into rows of ``STRIDE`` tokens: log probability of the next token at each place, and of a word's begin there.

        Row i is scored once, with row i - 1 as context unless it is ``alone``.  As there
        is one layer, all that a token brings (query, key, value, and what it adds itself) is one row of
        a table, looked up once; a window is a view of two rows.  Values carry a one, whose
        weighted sum is the softmax's divisor and, divided by itself, the input for biases.
        """
        p, n = self.p, len(ids)
        keys, width = p["q"].shape[1], p["q"].shape[0]
        q_of, k_of, v_of = p["embed"] @ p["q"] * np.float32(keys**-0.5), p["embed"] @ p["k"], p["embed"] @ p["v"] @ p["o"]
        wild = np.sqrt((q_of**2).sum(axis=1).max() * (k_of**2).sum(axis=1).max()) > 60
        near = np.where(self.past, np.exp(p["near"][self.distance]), np.float32(0)).astype(np.float32)
        one = np.ones((len(q_of), 1), dtype=np.float32)
        table = np.concatenate([q_of, k_of, v_of, one, p["embed"], 0 * one], axis=1).astype(np.float32)
        query, key, value, itself = np.split(np.arange(table.shape[1]), [keys, 2 * keys, 2 * keys + width + 1])
        query, key, value, itself = (slice(x[0], x[-1] + 1) for x in (query, key, value, itself))
        w1 = np.concatenate([p["w1"], p["b1"][None]])
        w2 = np.concatenate([p["w2"], np.zeros((len(p["w2"]), 1), dtype=np.float32)], axis=1)
        target = np.r_[ids.ravel()[1:], 0]
        h = np.empty((n, STRIDE, width + 1), dtype=np.float32)
        brought = np.empty((slab + 1, STRIDE, table.shape[1]), dtype=np.float32)
        row, token, number = brought.strides
        windows = np.lib.stride_tricks.as_strided(brought, (slab, WINDOW, table.shape[1]), (row, token, number), writeable=False)
        weights = np.empty((slab, STRIDE, WINDOW), dtype=np.float32)
        gated = np.empty((slab * STRIDE, w1.shape[1]), dtype=np.float32)
        for a in range(0, n, slab):
            m = min(slab, n - a)
            np.take(table, ids[a - 1 : a + m] if a else np.concatenate([ids[:1], ids[:m]]), axis=0, out=brought[: m + 1], mode="clip")
            s = np.matmul(brought[1 : m + 1, :, query], windows[:m, :, key].transpose(0, 2, 1), out=weights[:m])
            if wild:
                np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            s *= near
            s[alone[a : a + m], :, :STRIDE] = 0
            own = np.matmul(s, windows[:m, :, value], out=h[a : a + m])
            own /= own[:, :, width:].copy()
            own += brought[1 : m + 1, :, itself]
            flat = own.reshape(m * STRIDE, width + 1)
            inner = np.matmul(flat, w1, out=gated[: len(flat)])
            np.maximum(inner, 0, out=inner)
            flat += inner @ w2
        h, out, starts = h.reshape(n * STRIDE, width + 1), np.empty(n * STRIDE), np.empty(n * STRIDE)
        # logits are bounded by the hidden states' length; only beyond the range of exp must they be clipped
        reach = np.sqrt(np.einsum("ij,ij->i", h, h).max()) if n else 0
        longest = max(np.sqrt((p["class"] ** 2).sum(axis=0)).max(), np.sqrt((p["member"] ** 2).sum(axis=1)).max())
        self.tame = reach * longest + max(np.abs(p["cb"]).max(), p["mb"].max()) < 80
        of_class, of_member = self.outputs()
        for a in range(0, len(h), 256 * slab):
            at = slice(a, a + 256 * slab)
            out[at], starts[at] = self.looked_up(h[at], target[at], of_class, of_member)
        return out, starts

    def gradients(self, ids: np.ndarray, alone: np.ndarray, target: np.ndarray, known: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the targets, weighted by ``known``, and its gradient.

        A line of ``ids`` is a run of rows of ``STRIDE`` tokens, of which the first is only
        context; a window is a view of two rows, so that a token's key and value are made once.
        Hidden states carry a one for biases.  Products go over some thousand tokens at a time,
        which the linear algebra library takes twice as fast as all at once.  Members of all
        classes are computed together, their tokens sorted by class into lines of ``CLASS`` of one class each.
        """
        p, g = self.p, {}
        kind = p["q"].dtype
        runs, tokens = ids.shape
        length, width, keys = tokens // STRIDE - 1, p["q"].shape[0], p["q"].shape[1]
        n, scale, seen = runs * length * STRIDE, kind.type(keys**-0.5), ids.ravel().astype(np.intp)
        project = np.concatenate([p["q"] * scale, p["k"], p["v"] @ p["o"]], axis=1)
        parts = runs // RUN if runs % RUN == 0 else runs

        def lots(a: np.ndarray) -> np.ndarray:
            return a.reshape(parts, -1, a.shape[-1])

        def times(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
            return (lots(a) @ np.ascontiguousarray(weights)).reshape(len(a), -1)

        def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (lots(a).swapaxes(1, 2) @ lots(b)).sum(axis=0)

        x = p["embed"].take(seen, axis=0)
        brought = times(x, project).reshape(runs, tokens, -1)
        run, token, number = brought.strides
        windows = np.ndarray((runs, length, WINDOW, brought.shape[2]), kind, brought, 0, (run, STRIDE * token, token, number))
        q, k, v = windows[..., STRIDE:, :keys], windows[..., keys : 2 * keys], windows[..., 2 * keys :]
        turned = np.empty((runs, keys + width + 1, tokens), dtype=kind)
        turned[:, -1] = 1
        np.matmul(project[:, keys:].T, x.reshape(runs, tokens, width).swapaxes(1, 2), out=turned[:, :-1])
        run, number, token = turned.strides
        turned = np.ndarray((runs, length, turned.shape[1], WINDOW), kind, turned, 0, (run, STRIDE * token, number, token))
        s = q @ turned[:, :, :keys]
        np.clip(s, -60, 60, out=s)
        np.exp(s, out=s)
        s *= np.where(self.past, np.exp(p["near"][self.distance]), kind.type(0))
        s.reshape(-1, STRIDE, WINDOW)[alone.ravel(), :, :STRIDE] = 0
        divisor = s.reshape(n, WINDOW) @ np.ones((WINDOW, 1), dtype=kind)
        mixed = (s @ v).reshape(n, width)
        mixed /= divisor
        h = np.empty((n, width + 1), dtype=kind)
        np.add(mixed.reshape(runs, -1, width), x.reshape(runs, tokens, width)[:, STRIDE:], out=h.reshape(runs, -1, width + 1)[:, :, :width])
        h[:, width] = 1
        inner = times(h, np.concatenate([p["w1"], p["b1"][None]]))
        np.maximum(inner, 0, out=inner)
        flat = times(inner, np.concatenate([p["w2"], np.zeros((len(p["w2"]), 1), dtype=kind)], axis=1))
        flat += h
        y, on = target.ravel(), known.ravel().astype(kind)
        on /= max(on.sum(), 1)
        c = self.class_of[y]
        of_class, of_member = self.outputs()
        # logits are bounded as in ``score``
        longest = max((p["class"] ** 2).sum(axis=0).max(), (p["member"] ** 2).sum(axis=1).max())
        tame = np.sqrt(np.einsum("ij,ij->i", flat, flat).max() * longest) + max(np.abs(p["cb"]).max(), p["mb"].max()) < 80

        def softmax(z: np.ndarray, own: np.ndarray, on: np.ndarray) -> tuple[float, np.ndarray]:
            """The loss; turns logits into their gradient but for a factor a row, which is returned."""
            own = own + np.arange(len(z)) * z.shape[1]
            if not tame:
                np.minimum(z, 80, out=z)
            np.exp(z, out=z)
            total = z @ np.ones(z.shape[1], dtype=kind)
            lost = -np.dot(np.log(z.take(own) / total + kind.type(1e-20)), on)
            z.reshape(-1)[own] -= total
            return lost, on / total

        z = times(flat, of_class)
        loss, weight = softmax(z, c, on)
        of_all = summed(flat * weight[:, None], z)
        g["class"], g["cb"] = of_all[:width], of_all[width]
        back = times(z, p["class"].T)
        back *= weight[:, None]
        order = np.argsort(c.astype(np.int16), kind="stable")
        count = np.bincount(c, minlength=len(of_member))
        lines = -(-count // CLASS)
        line, edge = np.repeat(np.arange(len(lines)), lines), np.r_[0, np.cumsum(lines) * CLASS]
        place = np.arange(n) + np.repeat(edge[:-1] - (np.cumsum(count) - count), count)
        from_, weight, into = np.zeros(len(line) * CLASS, dtype=np.int64), np.zeros(len(line) * CLASS, dtype=kind), np.empty(n, dtype=np.int64)
        from_[place], weight[place], into[order] = order, on[order], place
        lined = flat.take(from_, axis=0)
        z = (lined.reshape(len(line), CLASS, width + 1) @ of_member.take(line, axis=0)).reshape(-1, CLASS)
        lost, weight = softmax(z, self.member_of[y].take(from_), weight)
        loss += lost
        lined *= weight[:, None]
        of_all = np.zeros_like(of_member)
        for j, (a, b) in enumerate(itertools.pairwise(edge.tolist())):
            if a < b:
                np.matmul(lined[a:b].T, z[a:b], out=of_all[j])
        g["member"], g["mb"] = of_all[:, :width], of_all[:, width]
        found = z.reshape(len(line), CLASS, CLASS) @ np.ascontiguousarray(p["member"].swapaxes(1, 2)).take(line, axis=0)
        found = found.reshape(-1, width)
        found *= weight[:, None]
        back += found.take(into, axis=0)
        g["w2"] = summed(inner, back)
        di = times(back, p["w2"].T)
        di *= inner > 0
        of_all = summed(h, di)
        g["w1"], g["b1"] = of_all[:width], of_all[width]
        dh = times(di, p["w1"].T)
        dh += back
        # the softmax's mean gradient is that of the mixture itself; it meets the values' ones
        dm = np.empty((n, width + 1), dtype=kind)
        np.divide(dh, divisor, out=dm[:, :width])
        np.einsum("ij,ij->i", dm[:, :width], mixed, out=dm[:, width])
        np.negative(dm[:, width], out=dm[:, width])
        dm = dm.reshape(runs, length, STRIDE, width + 1)
        ds = dm @ turned[:, :, keys:]
        ds *= s
        g["near"] = np.bincount(self.distance.ravel(), ds.reshape(-1, STRIDE * WINDOW).sum(axis=0) * self.past.ravel(), minlength=WINDOW).astype(kind)
        # each row is the second half of one window and the first of the next
        d = np.empty((runs, length + 1, STRIDE, project.shape[1]), dtype=kind)
        d[:, 0, :, :keys] = 0
        np.matmul(ds, k, out=d[:, 1:, :, :keys])
        dw = np.empty((runs, length, WINDOW, keys + width), dtype=kind)
        np.matmul(ds.swapaxes(2, 3), q, out=dw[..., :keys])
        np.matmul(s.swapaxes(2, 3), dm[..., :width], out=dw[..., keys:])
        d[:, 0, :, keys:] = dw[:, 0, :STRIDE]
        np.add(dw[:, :-1, STRIDE:], dw[:, 1:, :STRIDE], out=d[:, 1:-1, :, keys:])
        d[:, -1, :, keys:] = dw[:, -1, STRIDE:]
        d = d.reshape(runs * tokens, -1)
        of_all = summed(x, d)
        g["q"], g["k"], of_value = of_all[:, :keys] * scale, of_all[:, keys : 2 * keys], of_all[:, 2 * keys :]
        g["v"], g["o"] = of_value @ p["o"].T, p["v"].T @ of_value
        dx = times(d, project.T)
        dx.reshape(runs, length + 1, STRIDE, width)[:, 1:] += dh.reshape(runs, length, STRIDE, width)
        order = np.argsort(seen.astype(np.uint16) if len(p["embed"]) < 2**16 else seen, kind="stable")
        seen = seen[order]
        head = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][seen[head]] = np.add.reduceat(dx.take(order, axis=0), head, axis=0)
        return float(loss), g

    def packed(self) -> bytes:
        """All weights, in the order of their names."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).tobytes()

    def unpacked(self, data: bytes) -> Attention:
        """This model with the weights of ``packed``."""
        out, flat, at = copy.copy(self), np.frombuffer(data, dtype=np.float32), 0
        out.p = {}
        for k in sorted(self.p):
            out.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).copy()
            at += self.p[k].size
        return out

    def fit(self, ids: np.ndarray, alone: np.ndarray, known: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 9) -> list[float]:
        """Adam with a falling rate; rows as in ``score``, ``known`` holds the weight of each place's next token.

        A step takes runs of ``RUN`` rows from anywhere.
        """
        rng, losses, step = np.random.default_rng(seed), [], 0
        if not len(ids):
            return losses
        keep_memory()
        # rows that fill the last run up weigh nothing
        more = -len(ids) % RUN
        flat = np.concatenate([ids[0], ids.ravel(), np.zeros(more * STRIDE + 1, dtype=ids.dtype)])
        known = np.concatenate([known, np.zeros((more, STRIDE), dtype=known.dtype)]).reshape(-1, RUN * STRIDE)
        alone = np.r_[alone, np.ones(more, dtype=bool)].reshape(-1, RUN)
        around, ahead = np.arange((RUN + 1) * STRIDE), np.arange(STRIDE + 1, (RUN + 1) * STRIDE + 1)
        names = sorted(self.p)
        weights = np.concatenate([self.p[k].ravel() for k in names])
        edge = np.r_[0, np.cumsum([self.p[k].size for k in names])]
        self.p = {k: weights[a:b].reshape(self.p[k].shape) for k, a, b in zip(names, edge[:-1], edge[1:], strict=True)}
        mean, square, runs = np.zeros_like(weights), np.zeros_like(weights), max(1, batch // RUN)
        steps = epochs * -(-len(known) // runs)
        for _ in range(epochs):
            order = rng.permutation(len(known))
            for a in range(0, len(order), runs):
                own = order[a : a + runs]
                start = own[:, None] * (RUN * STRIDE)
                loss, g = self.gradients(flat[start + around], alone[own], flat[start + ahead], known[own])
                losses.append(loss)
                step += 1
                now = rate * (1 - 0.95 * step / steps)
                g = np.concatenate([g[k].ravel() for k in names])
                mean *= np.float32(0.9)
                mean += g
                g *= g
                square *= np.float32(0.99)
                square += g
                # both are sums that weigh each gradient by one at first; ``level`` makes the root that of a mean
                level = (0.01 / (1 - 0.99**step)) ** 0.5
                np.sqrt(square, out=g)
                g += np.float32(1e-8 / level)
                np.divide(mean, g, out=g)
                g *= np.float32(now * 0.1 / (1 - 0.9**step) / level)
                weights -= g
        return losses
